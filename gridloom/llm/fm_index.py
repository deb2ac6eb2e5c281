"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of a few megabytes. Its words become
symbols: the id of a benchmark word, or a separator for any other word (no test
phrase can cross one, so stretches too short for the shortest phrase are left
out of the index). The suffix array of that sequence gives a
Burrows-Wheeler transform, a wavelet matrix answers its rank queries, and all
test phrases are searched backwards at once. Occurrences are located by walking
to sampled suffix positions, and their word ranges are merged to removal spans.

Nothing is shuffled: phrases go to the documents, in blocks of a bounded size.

Defined results: a null text or one without words has no words and no hits; a
benchmark row whose text has no words, or without item_id, is ignored; repeated
item_ids count once; repeated documents are judged each; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text searched, and broadcast, at once.
PHRASE_BLOCK_BYTES = 16 << 20
SAMPLE_EVERY = 8


def phrases(rows: list[tuple[object, str]], window: int = WINDOW) -> dict:
    """The distinct search windows of benchmark texts as symbol rows: words by vocabulary rank, padded on the left with -1."""
    rows = [(str(i), t) for i, t in rows if i is not None and t]
    buf, offsets = kernels.text_buffer(pa.array([t for _, t in rows], pa.large_string()))
    starts, ends, bounds = kernels.word_bounds(buf, offsets, kernels.ALNUM_SEP)
    words = kernels.word_hashes(buf, starts, ends, True)
    vocabulary, ids = np.unique(words, return_inverse=True)
    owners: dict[tuple[int, ...], set[str]] = {}
    for k, (item, _) in enumerate(rows):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        if own:
            for i in range(max(1, len(own) - window + 1)):
                owners.setdefault(tuple(own[i : i + window]), set()).add(item)
    found = list(owners)
    symbols = np.full((len(found), window), -1, np.int32)
    for k, p in enumerate(found):
        symbols[k, window - len(p) :] = p
    items = sorted({i for own in owners.values() for i in own})
    rank = {x: n for n, x in enumerate(items)}
    return {
        "vocabulary": vocabulary,
        "symbols": symbols,
        "length": np.array([len(p) for p in found], np.int64),
        "items": items,
        "owner_of": np.array([rank[i] for p in found for i in sorted(owners[p])], np.int64),
        "owner_at": np.cumsum([0, *(len(owners[p]) for p in found)]),
    }


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    step = 1
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        step *= 2
    return order


class WaveletMatrix:
    """Rank and access over small integers; one bit of the symbols to a level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, at = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[low], ones[at]
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these positions, and how often each occurs before its position."""
        low, here, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[low], ones[here]
            one = ones[here + 1] > b
            symbol = symbol * 2 + one
            low, here = np.where(one, zeros + a, low - a), np.where(one, zeros + b, here - b)
        return symbol, here - low


class FMIndex:
    """Counts and locates symbol phrases in sequences that separators (symbol 0) part."""

    def __init__(self, symbols: np.ndarray, size: int, sample_every: int = SAMPLE_EVERY):
        """symbols: int64, 0 for a separator, else 1..size-1. The first and the last one must be separators."""
        parts = symbols == 0
        n_parts = int(parts.sum())
        own = symbols + (n_parts - 1)
        own[parts] = np.arange(n_parts)  # each separator differs, so that no comparison crosses one
        order = suffix_array(own)
        before = symbols[order - 1]  # position 0 is a separator, whose predecessor is never asked for
        before[order == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.tree = WaveletMatrix(before, size)
        sampled = (order % sample_every == 0) | (before == 0)  # beginnings of stretches too: a walk never meets a separator
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]
        self.sampled = sampled

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix-array range of each phrase; rows are symbols, right-aligned, -1 before them."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.sampled), np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column].astype(np.int64)
            used = symbol >= 0
            at, symbol = live[used], symbol[used]
            if not len(at):
                break
            low[at] = self.first[symbol] + self.tree.rank(symbol, low[at])
            high[at] = self.first[symbol] + self.tree.rank(symbol, high[at])
            live = at[high[at] > low[at]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of these suffix-array rows."""
        steps, out, live, rows = 0, np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[rows]
            out[live[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            if len(live):
                symbol, rank = self.tree.access(rows)
                rows = self.first[symbol] + rank
            steps += 1
        return out


def vocabulary_ids(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + the rank of each word in the sorted vocabulary, 0 for other words. A table of leading bits spares most searches."""
    out = np.zeros(len(words), np.int64)
    if not len(vocabulary):
        return out
    table = np.zeros(1 << 20, bool)
    table[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(words >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, words[maybe]), len(vocabulary) - 1)
    same = vocabulary[at] == words[maybe]
    out[maybe[same]] = at[same] + 1
    return out


def shard_hits(words: np.ndarray, bounds: np.ndarray, book: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one shard's words: which words are hit, and the (document, item) pairs that occur."""
    none = np.zeros(0, np.int64)
    hit = np.zeros(len(words), bool)
    if not len(words) or not len(book["length"]):
        return hit, none, none
    ids = vocabulary_ids(words, book["vocabulary"])
    change = np.ones(len(words) + 1, bool)
    change[1:-1] = (ids[1:] == 0) != (ids[:-1] == 0)
    change[bounds] = True
    edges = np.flatnonzero(change)
    a, b = edges[:-1], edges[1:]
    keep = (ids[a] > 0) & (b - a >= int(book["length"].min()))
    a, size = a[keep], (b - a)[keep]
    if not len(a):
        return hit, none, none
    ends = np.cumsum(size + 1)
    place = np.repeat(a - (ends - size), size + 1) + np.arange(ends[-1])  # word of each index position; one before its stretch at separators
    heads = ends - size - 1
    symbols = ids[np.maximum(place, 0)]
    symbols[heads] = 0
    index = FMIndex(np.append(symbols, 0), len(book["vocabulary"]) + 1)
    low, high = index.search(np.where(book["symbols"] >= 0, book["symbols"] + 1, -1))
    n = high - low
    phrase = np.repeat(np.arange(len(n)), n)
    if not len(phrase):
        return hit, none, none
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n) + low[phrase]
    at = place[index.locate(rows)]
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + book["length"][phrase], -1)
    hit = np.cumsum(delta[:-1]) > 0
    document = np.searchsorted(bounds, at, "right") - 1
    pair = np.unique(np.stack([document, phrase], 1), axis=0)
    owners = book["owner_at"][pair[:, 1] + 1] - book["owner_at"][pair[:, 1]]
    document = np.repeat(pair[:, 0], owners)
    at = np.arange(len(document)) - np.repeat(np.cumsum(owners) - owners, owners) + np.repeat(book["owner_at"][pair[:, 1]], owners)
    pair = np.unique(np.stack([document, book["owner_of"][at]], 1), axis=0)
    return hit, pair[:, 0], pair[:, 1]


def cut_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, spans: list[tuple[int, int]], a: int) -> bytes:
    """Bytes lo..hi without the word spans; a: the row's first word."""
    out, at = [], lo
    for first, last in spans:
        out.append(buf[at : starts[a + first]].tobytes())
        at = int(ends[a + last - 1])
    out.append(buf[at:hi].tobytes())
    return b"".join(out)


def _scan(batches: Iterator[pa.RecordBatch], book: dict, texts: bool, carry: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """names: the columns to pass on, text among them. carry: results of earlier phrase blocks follow them."""
    for batch in batches:
        buf, offsets = kernels.text_buffer(batch.column(names.index("text")))
        before = {n: batch.column(len(names) + i) for i, n in enumerate(RESULT)} if carry else {}
        n_words, n_hit, items, spans, clean = [], [], [], [], []
        for lo, hi in kernels.blocks(offsets, SHARD_BYTES):
            own, part = offsets[lo : hi + 1] - offsets[lo], buf[offsets[lo] : offsets[hi]]
            starts, ends, bounds = kernels.word_bounds(part, own, kernels.ALNUM_SEP)
            hit, document, item = shard_hits(kernels.word_hashes(part, starts, ends, True), bounds, book)
            edge_at = np.searchsorted(document, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                a, b = int(bounds[k]), int(bounds[k + 1])
                found = [book["items"][i] for i in item[edge_at[k] : edge_at[k + 1]]]
                own_hit = hit[a:b]
                runs: list[tuple[int, int]] = []
                if own_hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own_hit, [False]]).astype(np.int8)))
                    runs = [(int(x), int(y)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
                if carry:
                    runs, found = _merged(runs, before["spans"][lo + k].as_py()), sorted({*found, *before["items"][lo + k].as_py()})
                n_words.append(b - a)
                n_hit.append(sum(y - x for x, y in runs))
                items.append(sorted(found))
                spans.append([{"start": x, "end": y} for x, y in runs])
                if texts:
                    clean.append(cut_spans(part, starts, ends, int(own[k]), int(own[k + 1]), runs, a).decode() if runs else None)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[: len(names)],
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(clean if texts else [None] * batch.num_rows, pa.string()),
            ],
            names=[*names, *RESULT],
        )


def _merged(runs: list[tuple[int, int]], more: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*runs, *((m["start"], m["end"]) for m in more)]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


RESULT = ("n_words", "n_hit", "items", "spans", "clean_text")
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, clean_text string"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, texts: bool = False, block_bytes: int = PHRASE_BLOCK_BYTES, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document the carried columns, n_words, n_hit, items (sorted as strings), spans (word ranges to remove), and clean_text (with texts, where anything is removed).

    The benchmark is read block by block, so that what is broadcast has a bound
    whatever its size; with more than one block, the blocks' passes follow each
    other and every second pass is written out, so that a task never holds more than two.
    """
    spark = docs.sparkSession
    names = [*carried, *([] if "text" in carried else ["text"])]
    df, carry = common.only(docs, *names), False
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + SCHEMA
    rows = common.only(benchmark, "item_id", "text")
    for n, block in enumerate([*common.small_rows(rows, block_bytes, lambda r: 4 * len(r.text or ""))] or [[]]):
        shared = spark.sparkContext.broadcast(phrases([(r.item_id, r.text) for r in block], window))
        if n and n % 2 == 0:
            df = common.cut(df, "fm")
        df = df.mapInArrow(lambda it, s=shared, c=carry: _scan(it, s.value, texts, c, names), schema)
        carry = True
    return df if "text" in carried or texts else df.drop("text")


def digest(result: DataFrame) -> DataFrame:
    """The digest columns of a decontamination result."""
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def brute_force(texts: list[str | None], items: list[tuple[object, str]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """The definition, word for word; for tests."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    book: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - window + 1)):
                book.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in book}:
            for i in range(len(w) - size + 1):
                if own := book.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


__all__ = ["FMIndex", "WaveletMatrix", "brute_force", "decontaminate", "digest", "phrases", "suffix_array"]
