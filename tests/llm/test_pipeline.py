"""The stages of corpus_pipeline.py, each against a brute-force version of what it keeps."""

import re

import pytest
import sentencepiece

from gridloom.llm import common, fm_index, queries, superminhash

from .conftest import make, messy
from .test_pii import base

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("source", ["sf", "messy"])
def test_stages(spark, sf, source):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "sf" else make(spark, messy())
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = common.cut(stage(spark, docs, sf), f"test-{name}")
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == columns
            after = [(r.doc_id, r.text) for r in rows]
            if source == "sf":
                assert all(r.n_chars == len(r.text) for r in rows)
        if name == "language_id":
            assert sorted(after, key=str) == sorted(((i, t) for i, t in before if t and any(c.isalpha() for c in t)), key=str)
        elif name == "near_dedup":
            kept = {i for i, _, _, k in superminhash.brute_force([b for b in before if b[0] is not None], 5, 80) if k}
            assert sorted((i for i, _ in after if i is not None)) == sorted(kept)
            assert sum(i is None for i, _ in after) == sum(i is None for i, _ in before)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = fm_index.brute_force([t for _, t in before], items)
            assert sorted(map(str, (i for i, _ in after))) == sorted(str(i) for (i, _), (n, hit, _) in zip(before, want) if hit == 0 or hit < n)
            left = dict(after)
            for (i, t), (n, hit, _) in zip(before, want):
                if hit == 0 and i is not None:
                    assert left[i] == t
                elif hit < n and i is not None:
                    assert fm_index.brute_force([left[i]], [])[0][0] == n - hit
        elif name == "pii":
            assert len(after) == len(before)
            left = {i: t for i, t in after if i is not None}
            for i, t in before:
                if i is not None:
                    assert not base(left[i])
                    if not base(t) and "[ID]" not in left[i]:
                        assert left[i] == t
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
            assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == sorted((str(i), sp.encode(t), sp.decode(sp.encode(t))) for i, t in before)
        docs = out


def test_empty(spark, sf):
    docs = make(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, sf), f"test-{name}")
        assert docs.count() == 0


def test_repeated_ids(spark, sf):
    docs = make(spark, [(1, "some words of text"), (1, "other words of text"), (1, "some words of text"), (2, "a third one"), (None, "x y"), (None, "x y")])
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, "other words of text"), (2, "a third one"), (None, "x y"), (None, "x y")]))


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "decoded"] and 0 < got.count() <= 200
    assert not re.search("@", " ".join(r.decoded for r in got.collect() if base(r.decoded)))
