"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector. A trigram binds the vectors of its
letters, each rolled by its place, by multiplication; a text bundles (sums) the
trigrams of its words, and so does each language over its training texts. A
text gets the language whose prototype has the largest cosine with its vector.

Texts are lower-cased; runs of other characters than letters count as one
boundary symbol. All of every text counts. Prototypes come from counts over all
training rows: each task sends one vector per language, however many rows it has.

Defined results: a null text, or one without letters, is `und` with score 0;
ties go to the language that sorts first; without training rows every text is
`und`; a negative cosine counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1024
#: Letters share so many random vectors; those below U+0400 have one of their own.
SYMBOLS = 2048
BLOCK_CHARS = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def letter_table(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point (0: not a letter) and the vector of each symbol."""
    if dimensions not in _tables:
        symbols = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if chr(c).isalpha():
                symbols[c] = c + 1 if c < 0x400 else 0x400 + 1 + c * 2654435761 % (SYMBOLS - 0x401)
        vectors = np.random.default_rng(7).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        _tables[dimensions] = symbols, vectors.astype(np.int8)
    return _tables[dimensions]


def trigram_vectors(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    a, b, c = codes >> 22, codes >> 11 & 2047, codes & 2047
    return (np.roll(vectors, 2, 1)[a] * np.roll(vectors, 1, 1)[b] * vectors[c]).astype(np.float32)


def trigrams(texts: list[str | None], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of the texts' trigrams: row, code, count."""
    rows, codes, counts = [], [], []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= BLOCK_CHARS):
            size += len(texts[to] or "")
            to += 1
        own = [f" {(t or '').lower()} " for t in texts[at:to]]
        points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = symbols[points]
        doc = np.repeat(np.arange(at, to), [len(x) for x in own])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])  # one boundary for a run of them
        s, doc = s[keep], doc[keep]
        if len(s) >= 3:
            same = (doc[2:] == doc[:-2]) & (s[1:-1] > 0)  # a boundary in the middle says nothing of a word
            key = (doc[2:] - at << 33 | s[:-2] << 22 | s[1:-1] << 11 | s[2:])[same]
            key.sort()
            if len(key):
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                rows.append((key[first] >> 33) + at)
                codes.append(key[first] & ((1 << 33) - 1))
                counts.append(np.diff(np.append(first, len(key))))
        at = to
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (rows, codes, counts))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bundle(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    symbols, vectors = letter_table(dimensions)
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs], np.int64)
        for lo in range(0, len(langs), 512):
            row, code, count = trigrams(batch.column("text").slice(lo, 512).to_pylist(), symbols)
            if not len(code):
                continue
            distinct, at = np.unique(code, return_inverse=True)
            table = np.bincount(of[lo + row] * len(distinct) + at, count, len(names) * len(distinct)).reshape(len(names), -1)
            sums = np.zeros((len(names), dimensions))
            for part in range(0, len(distinct), 4096):
                sums += table[:, part : part + 4096] @ trigram_vectors(distinct[part : part + 4096], vectors)
            for name, x in zip(names, sums, strict=True):
                totals[name] = totals.get(name, 0) + x
    names = sorted(totals)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([totals[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "vector"])


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language over all training rows (text and lang not null). Tasks' vectors are summed by language and dimension; the driver gets one number for each of these."""
    rows = common.only(training, "text", "lang").where("text is not null and lang is not null")
    parts = rows.mapInArrow(lambda it: _bundle(it, dimensions), "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():
        out.setdefault(r.lang, np.zeros(dimensions))[r["at"]] = r.v
    return out


def predict(texts: list[str | None], names: list[str], matrix: np.ndarray, dimensions: int) -> tuple[list[str], np.ndarray]:
    """Languages and scores; matrix: unit prototypes, a row for each name."""
    symbols, vectors = letter_table(dimensions)
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    for lo in range(0, len(texts), 256):
        own = texts[lo : lo + 256]
        row, code, count = trigrams(own, symbols)
        if not len(code) or not names:
            continue
        distinct, at = np.unique(code, return_inverse=True)
        sums = np.zeros((len(own), dimensions), np.float32)
        for part in range(0, len(distinct), 4096):
            used = (at >= part) & (at < part + 4096)
            wide = min(4096, len(distinct) - part)
            table = np.bincount(row[used] * wide + at[used] - part, count[used], len(own) * wide).reshape(len(own), wide)
            sums += table.astype(np.float32) @ trigram_vectors(distinct[part : part + 4096], vectors)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums, dtype=np.float64))
        cosine = (sums @ matrix.T.astype(np.float32)).astype(np.float64) / np.maximum(length, 1e-30)[:, None]
        best = cosine.argmax(1)
        for k in np.unique(row):
            langs[lo + k], scores[lo + k] = names[best[k]], min(1.0, max(0.0, cosine[k, best[k]]))
    return langs, scores


def _predict(batches: Iterator[pa.RecordBatch], names: list[str], matrix: np.ndarray, dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = predict(batch.column("text").to_pylist(), names, matrix, dimensions)
        rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(langs, pa.string()), pa.array(scores)], names=[*(batch.schema.names[i] for i in rest), "lang_pred", "score"])


def _predict_all(batches: Iterator[pa.RecordBatch], names: list[str], matrix: np.ndarray, dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = predict(batch.column("text").to_pylist(), names, matrix, dimensions)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])


def unit_rows(bundles: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = sorted(n for n, v in bundles.items() if np.any(v))
    return names, np.stack([bundles[n] / np.linalg.norm(bundles[n]) for n in names]) if names else np.zeros((0, 1))


def identify(docs: DataFrame, bundles: dict[str, np.ndarray], columns: list[str], keep_text: bool = False, dimensions: int = DIMENSIONS) -> DataFrame:
    """These columns with lang_pred and score (with the text too, if asked for)."""
    names, matrix = unit_rows(bundles)
    df = common.only(docs, *columns, *([] if "text" in columns else ["text"]))
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if keep_text or n != "text")
    run = _predict_all if keep_text else _predict
    return df.mapInArrow(lambda it: run(it, names, matrix, dimensions), f"{kinds}, lang_pred string, score double")


def language_id(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    bundles = prototypes(docs.where(~held_out()), dimensions)
    return identify(docs.select("doc_id", "text"), bundles, ["doc_id"], dimensions=dimensions).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
