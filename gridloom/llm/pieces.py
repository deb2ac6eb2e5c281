"""SentencePiece encoding and decoding through a distinct-chunk table.

When no piece of the model has a whitespace marker after another character, no
merge crosses the place where a marked word begins, so the words can be
segmented one by one. A task keeps a table of the marked words it has met, each
segmented once, and joins their ids back by position; the text's ids are then
decoded by the library. The table is emptied when
it reaches a bound, which changes no result. A model whose pieces do cross
markers, or whose normaliser rewrites text, is applied to whole texts instead.

Tables live in the tasks rather than in a shuffled global table: a row for each
word position would be many times the input on disk, and the whole vocabulary
of a corpus has no bound that would allow a broadcast.

Defined results: a null or empty text has no ids and decodes to the empty string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
TABLE_ENTRIES = 400_000
#: Characters of text whose chunks are looked up together.
GROUP_CHARS = 1 << 19


class Segmenter:
    """The library's encode and decode for whole texts, one distinct marked word at a time."""

    def __init__(self, model: bytes, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.entries, self.table = entries, {}
        self.chunked = self._separable()
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.decimal = [*map(str, range(len(pieces)))]
        self.lone = ",".join(map(str, self.sp.encode("a ")[len(self.sp.encode("a")) :]))  # a marker at the end of a text

    def _separable(self) -> bool:
        sp = self.sp
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
        plain = all(sp.normalize(x) == y for x, y in (("a  b", f"{MARK}a{MARK}{MARK}b"), (" a ", f"{MARK}{MARK}a{MARK}"), ("ﬁ①　x\t", f"{MARK}ﬁ①　x\t")))
        return plain and not any(MARK in p.lstrip(MARK) for p in pieces)

    def chunks(self, text: str) -> list[str]:
        """Marked words without their first marker."""
        if "  " in text or MARK in text or text[:1] == " ":
            return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def fill(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks."""
        new = [*chunks.difference(self.table)]
        if not new:
            return
        if len(self.table) + len(new) > self.entries:
            self.table.clear()
            new = [*chunks]
        plain = [c for c in new if c and MARK not in c]
        text = " ".join(plain)
        ids = np.array(self.sp.encode(text), np.int64)
        begins = np.flatnonzero(self.marked[ids]) if len(ids) else ids
        if len(begins) == len(plain) and self.sp.decode(ids.tolist()) == text:
            words = [*map(self.decimal.__getitem__, ids.tolist())]
            bounds = [*begins.tolist(), len(ids)]
            for chunk, a, b in zip(plain, bounds, bounds[1:]):
                self.table[chunk] = ",".join(words[a:b])
            new = [c for c in new if not c or MARK in c]
        for chunk in new:
            own = self.sp.encode(chunk)
            self.table[chunk] = ",".join(map(str, own)) if chunk else self.lone

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text all ids in decimal, joined by commas, and their decoded text."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= GROUP_CHARS):
                size += len(texts[to] or "")
                to += 1
            yield from self._encode(texts[at:to])
            at = to

    def _encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        if not self.chunked:
            for text in texts:
                ids = self.sp.encode(text or "")
                yield ",".join(map(str, ids)), self.sp.decode(ids) if ids else ""
            return
        split = [self.chunks(text) if text else [] for text in texts]
        self.fill(set().union(*split))
        for text, chunks in zip(texts, split, strict=True):
            ids = ",".join(map(self.table.__getitem__, chunks))
            yield ids, self.sp.decode([*map(int, ids.split(","))]) if ids else ""


_cached: dict[bytes, Segmenter] = {}


def _segmenter(model: bytes) -> Segmenter:
    key = hashlib.md5(model).digest()
    if key not in _cached:
        _cached.clear()
        _cached[key] = Segmenter(model)
    return _cached[key]


def _digests(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    s = _segmenter(model)
    for batch in batches:
        n, ids_sha, text_sha = [], [], []
        for ids, back in s.encode(batch.column("text").to_pylist()):
            n.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(back.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    s = _segmenter(model)
    for batch in batches:
        ids, back = [], []
        for own, decoded in s.encode(batch.column("text").to_pylist()):
            ids.append(np.fromstring(own, np.int32, sep=",") if own else np.zeros(0, np.int32))
            back.append(decoded)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
        rest = [batch.column(i) for i, x in enumerate(batch.schema.names) if x != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes), lists, pa.array(back, pa.string())], names=[*names, "n_tokens", "ids", "decoded"])


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text. The model file, some hundred kilobytes, is broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    kind = dict(docs.dtypes)["doc_id"]
    return common.only(docs, "doc_id", "text").mapInArrow(lambda it: _digests(it, model.value), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model_path: str, *carried: str) -> DataFrame:
    """The carried columns, n_tokens, ids and the decoded text."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    df = common.only(docs, *carried, "text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes[:-1])
    return df.mapInArrow(lambda it: _ids(it, model.value), f"{kinds}, n_tokens long, ids array<int>, decoded string")
