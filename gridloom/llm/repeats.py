"""Where long windows of documents repeat: the distributed part of both substring operators.

1. Every run of windows around an anchor (see anchors) becomes a row of
   fingerprints and positions. Anchors that occur once are dropped.
2. Runs with equal contexts are the same passage: it is stored once, with the
   number of its holders and the least of them.
3. The symbols of each such passage go to the shard of its anchor, where the
   caller's kernel (suffix automata, suffix arrays) decides which of its windows
   repeat. Passages that are alone at their anchor need no kernel: all of them
   repeats with its second holder. If only earlier documents count, all later
   holders of a passage repeat as a whole.
4. An anchor with more passages than a task should hold is not sent to a shard:
   its windows are spread by their own fingerprints and aggregated instead.

All aggregations combine on the map side; hot anchors and contexts only meet in
joins, which adaptive execution splits: no aggregation by anchor shares a stage
with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common, kernels

#: Anchors with more distinct contexts are spread by window: a shard's task holds about a megabyte of one anchor at most.
HOT_CONTEXTS = 1 << 10
#: Up to so many rows of positions (some 40 bytes each) are broadcast to their documents; more are joined.
BROADCAST_ROWS = 1 << 19
MARKS = "anchor long, ctx long, marks binary"


def word_symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints and the rows' bounds among them."""
    starts, ends, bounds = kernels.word_bounds(buf, offsets, kernels.SPACE_SEP)
    return kernels.word_hashes(buf, starts, ends, False), bounds


def byte_symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return buf, offsets


def _sums(symbols: np.ndarray) -> np.ndarray:
    return kernels.prefix(kernels.byte_values(symbols) if symbols.dtype == np.uint8 else symbols)


def _runs(batches: Iterator[pa.RecordBatch], symbols_of, length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = kernels.text_buffer(batch.column("text"))
        keys, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
        for a, b in kernels.blocks(offsets):
            symbols, bounds = symbols_of(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row, start, n, anchor, context = anchors.runs(_sums(symbols), bounds, length, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kernels.signed(anchor)), pa.array(kernels.signed(context)), pa.array(keys[a + row]), pa.array(ids[a + row]), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                names=["anchor", "ctx", "row", "id", "s", "n"],
            )


def _payloads(batches: Iterator[pa.RecordBatch], symbols_of, length: int) -> Iterator[pa.RecordBatch]:
    """The symbols of the contexts that each document holds."""
    for batch in batches:
        buf, offsets = kernels.text_buffer(batch.column("text"))
        out: dict[str, list] = {c: [] for c in ("anchor", "ctx", "id", "cnt", "payload")}
        for i, items in enumerate(batch.column("items").to_pylist()):
            symbols, _ = symbols_of(buf[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            for x in items:
                for c in ("anchor", "ctx", "id", "cnt"):
                    out[c].append(x[c])
                out["payload"].append(symbols[x["s"] : x["s"] + x["n"] + length - 1].tobytes())
        yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("anchor", "ctx", "id", "cnt")), pa.array(out["payload"], pa.binary())], names=[*out])


def _windows(batches: Iterator[pa.RecordBatch], dtype: str, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            prints = kernels.windows(_sums(np.frombuffer(x["payload"], dtype)), length)
            n = len(prints)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kernels.signed(prints)), *(pa.array(np.full(n, x[c], np.int64)) for c in ("anchor", "ctx", "id", "cnt")), pa.array(np.arange(n), pa.int32())], names=["print", "anchor", "ctx", "id", "cnt", "o"]
            )


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row is the same for rows with equal doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    return common.only(docs, "doc_id", "text").select(F.xxhash64("doc_id", text).alias("row"), "doc_id", text.alias("text"))


def _join_rows(docs: DataFrame, more: DataFrame, n: int, how: str = "inner") -> DataFrame:
    return docs.join(F.broadcast(more) if n <= BROADCAST_ROWS else more.hint("merge"), "row", how)


def runs_of(docs: DataFrame, symbols_of, length: int, k: int, earlier: bool) -> DataFrame:
    """(anchor, ctx, row, id, s, n) of every run of windows of documents (row, doc_id, text)."""
    own = docs.select("row", F.col("doc_id").cast("long").alias("id"), "text")
    own = own.where("id is not null") if earlier else own.withColumn("id", F.coalesce("id", F.lit(0)))
    return own.mapInArrow(lambda it: _runs(it, symbols_of, length, k), "anchor long, ctx long, row long, id long, s int, n int")


def held_contexts(runs: DataFrame) -> DataFrame:
    """(anchor, ctx, cnt, held): each distinct passage, the number of its holders and the least of them."""
    return runs.groupBy("anchor", "ctx").agg(F.count("*").alias("cnt"), F.min(F.struct("id", "row", "s", "n")).alias("held"))


def payloads(docs: DataFrame, passages: DataFrame, n: int, symbols_of, length: int) -> DataFrame:
    """(anchor, ctx, id, cnt, payload) of n passages (anchor, ctx, cnt, id, row, s, n): the symbols, read from the holders' texts."""
    items = passages.groupBy("row").agg(F.collect_list(F.struct("anchor", "ctx", "id", "cnt", "s", "n")).alias("items"))
    texts = _join_rows(docs.select("row", "text"), items, n)
    return texts.mapInArrow(lambda it: _payloads(it, symbols_of, length), "anchor long, ctx long, id long, cnt long, payload binary")


def repeated_ranges(docs: DataFrame, symbols_of, dtype: str, length: int, k: int, earlier: bool, kernel, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(row, spans): for each document, int32 pairs of the merged ranges that repeated windows cover.

    earlier: a window must start in a document of a smaller id; else anywhere
    else. kernel: sorted shard batches of (anchor, ctx, id, cnt, payload) to
    (anchor, ctx, marks), marks being int32 pairs: ranges of offsets of repeated
    windows.
    """
    spark = docs.sparkSession
    runs = common.cut(runs_of(docs, symbols_of, length, k, earlier), "runs")
    several = runs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi") if earlier else runs.groupBy("anchor").count().where("count > 1")
    runs = common.cut(runs.join(common.cut(several.select("anchor"), "anchors"), "anchor"), "runs")
    contexts = common.cut(held_contexts(runs), "contexts")
    sizes = common.cut(contexts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    several_ = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes.hint("merge")
    met = contexts.join(several_, "anchor")
    open_ = common.cut(met.select("anchor", "ctx", "cnt", "m", "held.id", "held.row", "held.s", "held.n"), "open")
    n_open = open_.count()
    pick = lambda test: payloads(docs, open_.where(test), n_open, symbols_of, length)
    dealt = pick(F.col("m") <= hot).repartition(common.parallelism(spark), "anchor").sortWithinPartitions("anchor", "id", "ctx")
    marks = dealt.mapInArrow(lambda it: kernel(it, length), MARKS)
    if not sizes.where(F.col("m") > hot).isEmpty():
        spread = common.cut(pick(F.col("m") > hot).dropDuplicates(["anchor", "ctx"]).mapInArrow(lambda it: _windows(it, dtype, length), "print long, anchor long, ctx long, id long, cnt long, o int"), "windows")
        by_print = spread.groupBy("anchor", "print").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("cnt").alias("total"))
        by_print = common.cut(by_print.where("first < last" if earlier else "total > 1"), "prints")
        hits = spread.join(by_print, ["anchor", "print"]).where("id > first" if earlier else "true").groupBy("anchor", "ctx").agg(F.collect_list("o").alias("o"))
        marks = marks.union(hits.mapInArrow(_packed, MARKS))
    marks = common.cut(marks, "marks")
    end = (F.col("s") + F.col("n") - 1 + length).alias("e")
    if not earlier:  # what is alone at its anchor has several holders
        alone = runs.join(several_, "anchor", "left_anti").select("row", "s", end)
        return common.cut(ranges(alone.union(covered(runs, marks, length))), "ranges")
    placed = common.cut(runs.join(contexts.select("anchor", "ctx", F.col("held.id").alias("first")), ["anchor", "ctx"]), "placed")
    later = placed.where("id > first").select("row", "s", end)
    return common.cut(ranges(later.union(covered(placed.where("id = first"), marks, length))), "ranges")


def covered(runs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """(row, s, e) ranges that marked windows cover, for every holder of a marked passage."""
    return runs.join(marks, ["anchor", "ctx"]).mapInArrow(lambda it: _marked(it, length), "row long, s int, e int")


def ranges(parts: DataFrame) -> DataFrame:
    """(row, spans): merged ranges by row, from (row, s, e)."""
    return parts.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans")).mapInArrow(_merge, "row long, spans binary")


def packed(offsets: np.ndarray) -> bytes:
    """Sorted offsets of marked windows as int32 pairs (first, end) of their runs."""
    edge = np.flatnonzero(np.diff(offsets) > 1)
    return np.stack([offsets[np.append(0, edge + 1)], offsets[np.append(edge, len(offsets) - 1)] + 1], 1).astype(np.int32).tobytes()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [packed(np.unique(np.array(o, np.int32))) for o in batch.column("o").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("ctx"), pa.array(marks, pa.binary())], names=["anchor", "ctx", "marks"])


def _marked(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranges that runs of marked windows cover."""
    for batch in batches:
        pairs = [np.frombuffer(m.as_buffer(), np.int32) for m in batch.column("marks")]
        sizes = [len(p) // 2 for p in pairs]
        flat = np.concatenate(pairs).reshape(-1, 2) if pairs else np.zeros((0, 2), np.int32)
        start = np.repeat(batch.column("s").to_numpy(), sizes)
        row = np.repeat(batch.column("row").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start + flat[:, 0], pa.int32()), pa.array(start + flat[:, 1] - 1 + length, pa.int32())], names=["row", "s", "e"])


def merged(pairs: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges that cover the same; rows are (start, end)."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    top = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > top[:-1]]))
    return np.stack([pairs[first, 0], top[np.append(first[1:], len(pairs)) - 1]], 1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        flat = spans.flatten()
        pairs = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], 1).astype(np.int32) if len(flat) else np.zeros((0, 2), np.int32)
        at = spans.offsets.to_numpy() - spans.offsets[0].as_py()
        out = [merged(pairs[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], names=["row", "spans"])


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every document; spans is null where nothing repeats. The ranges are broadcast if they are few and small, else joined."""
    size = ranges.agg(F.count("*").alias("n"), F.sum(F.length("spans")).alias("b")).first()
    n = size.n if (size.b or 0) <= 32 * BROADCAST_ROWS else BROADCAST_ROWS + 1
    return _join_rows(docs, ranges, n, "left").select("doc_id", "text", "spans")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each anchor of a sorted shard; rows that repeat (anchor, ctx) count once."""
    held: dict[str, list] | None = None
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for anchor, ctx, own, cnt, payload in zip(*(cols[c] for c in ("anchor", "ctx", "id", "cnt", "payload")), strict=True):
            if held and held["anchor"][0] == anchor:
                if held["ctx"][-1] == ctx:
                    continue
            else:
                if held:
                    yield held
                held = {c: [] for c in ("anchor", "ctx", "id", "cnt", "payload")}
            for c, v in (("anchor", anchor), ("ctx", ctx), ("id", own), ("cnt", cnt), ("payload", payload)):
                held[c].append(v)
    if held:
        yield held


def mark_batches(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, bytes]] = []
    for anchor, ctx, marks in found:
        rows.append((anchor, ctx, packed(marks)))
        if len(rows) >= 4096:
            yield _mark_batch(rows)
            rows = []
    yield _mark_batch(rows)


def _mark_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["anchor", "ctx", "marks"])
