import hashlib

import pytest
import sentencepiece

from gridloom.llm import pieces, queries

from .conftest import make, messy

PATH = queries.tokenizer_path(queries.PIECE_MODEL)
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b  ", "a▁b", "▁", "▁▁ x", "tab\tnew\nline\r\n x", "\x00", "ﬁ ①　Å é", "😀 👩‍👩‍👧 emoji", "<s> </s> <unk> x", "<0x41> <0x0A>", "日本語 テキスト", " nbsp ", "﻿bom", "x" * 5000, "ab " * 3000, "​zero", "à́̂ ", "＜ｓ＞"]


def expected(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = []
    for t in texts:
        ids = sp.encode(t or "")
        out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("entries", [pieces.TABLE_ENTRIES, 40])
def test_like_the_library(entries):
    texts = ODD + [t for _, t in messy()]
    s = pieces.Segmenter(pieces.model_bytes(PATH), entries)
    assert s.chunked
    got = [(i.count(",") + 1 if i else 0, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()) for i, b in s.encode(texts)]
    for t, a, b in zip(texts, got, expected(texts), strict=True):
        assert a == b, repr((t or "")[:60])


def test_messy(spark):
    docs = messy()
    got = sorted(map(tuple, pieces.digests(make(spark, docs), PATH).collect()), key=str)
    assert got == sorted(((i, *e) for (i, _), e in zip(docs, expected([t for _, t in docs]))), key=str)
    assert pieces.digests(make(spark, []), PATH).count() == 0


def test_ids_round_trip(spark):
    docs = messy(2, 10)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in pieces.encode(make(spark, docs), PATH, "doc_id", "lang").collect():
        assert r.decoded == (sp.decode(r.ids) if r.ids else "") and r.n_tokens == len(r.ids)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op6_sentencepiece(spark, sf).collect()))
    assert got == sorted((i, *e) for (i, _), e in zip(docs, expected([t for _, t in docs])))
