"""Exact top-k inner-product search by distributed histogram selection.

Every pass scores all candidates against a block of queries, block matrix by
block matrix, and returns only counts: how many scores of a query fall into
each bin of its current interval. The summed histograms tell in which bin the
k-th largest score lies; that bin becomes the next interval, until it is one
score wide. Then one pass emits the scores above the k-th value, and of those
equal to it the smallest ids that are still needed.

A partition leaves out bins below its own k-th largest score: the k-th largest
of all cannot lie there. It emits at most k rows for each query, whatever the
number of ties, so the last step sorts at most k rows for each query and
partition.

Queries are read in blocks of a bounded size; each block is matched with the
whole table, which is never collected.

Defined results: vectors that are null, or hold a null or non-finite component,
or have no id, take no part; a query only meets vectors of its own length; rows
that share the query's id are not its candidates; repeated query rows are
answered each; scores beyond +-(2**62 - 1) count as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BINS = 2048
QUERY_BLOCK_BYTES = 2 << 20
CELLS = 1 << 20
LIMIT = 2**62 - 1


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, x): the vectors that take part, each component floor(scale * x) as a double."""
    x = F.col(f"`{vector_column}`")
    fits = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    ints = F.transform(x, lambda c: F.expr("double(1)") * F.floor(c.cast("double") * scale).cast("double"))
    return vectors.where(fits & F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("long").alias("id"), ints.alias("x"))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of this length, and their vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(sizes == width)
    if len(rows) == len(sizes):
        return rows, flat.reshape(len(rows), width)
    starts = (column.offsets.to_numpy() - column.offsets[0].as_py())[:-1]
    return rows, flat[starts[rows][:, None] + np.arange(width)]


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products (queries by rows) as int64: exact, by double arithmetic where that holds them, else by whole numbers of any size."""
    top = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if top < 2**53:
        return (queries @ rows.T).astype(np.int64)
    a = np.array([[int(v) for v in q] for q in queries.tolist()], object).reshape(queries.shape)
    b = np.array([[int(v) for v in r] for r in rows.tolist()], object).reshape(rows.shape)
    return np.clip(a @ b.T, -LIMIT, LIMIT).astype(np.int64)


def _scores(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the work: query numbers, candidate ids, and the score matrix with the queries' own rows masked."""
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for width, (numbers, own, queries) in block.items():
            rows, x = matrix(batch.column("x"), width)
            step = max(1, CELLS // max(1, len(numbers)))
            for lo in range(0, len(rows), step):
                part = ids[rows[lo : lo + step]]
                yield numbers, part, inner(queries, x[lo : lo + step]), part[None, :] != own[:, None]


def _histogram(batches: Iterator[pa.RecordBatch], block: dict, low: np.ndarray, width: np.ndarray, bins: np.ndarray, above: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(q, bin, n): counts of the scores in [low, low + bins * width)."""
    totals = np.zeros((len(low), BINS), np.int64)
    for numbers, _, scores, allowed in _scores(batches, block):
        at = (scores - low[numbers][:, None]) // width[numbers][:, None]
        used = allowed & (at >= 0) & (at < bins[numbers][:, None])
        row, column = np.nonzero(used)
        totals[numbers] += np.bincount(row * BINS + at[row, column], minlength=len(numbers) * BINS).reshape(-1, BINS)
    beyond = totals[:, ::-1].cumsum(1)[:, ::-1] - totals  # in higher bins
    q, at = np.nonzero((totals > 0) & (beyond < (k - above)[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(at, pa.int32()), pa.array(totals[q, at])], names=["q", "bin", "n"])


def _emit(batches: Iterator[pa.RecordBatch], block: dict, least: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(q, id, score) of scores that reach the least one; of a task's rows for a query only the k best."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for numbers, ids, scores, allowed in _scores(batches, block):
        row, column = np.nonzero(allowed & (scores >= least[numbers][:, None]))
        if not len(row):
            continue
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q, own, s = int(numbers[row[a]]), ids[column[a:b]], scores[row[a], column[a:b]]
            if q in held:
                own, s = np.concatenate([held[q][0], own]), np.concatenate([held[q][1], s])
            if len(own) > k:
                best = np.lexsort((own, -s))[:k]
                own, s = own[best], s[best]
            held[q] = own, s
    q = np.concatenate([np.full(len(held[n][0]), n) for n in held]) if held else np.zeros(0, np.int64)
    ids, s = (np.concatenate([held[n][i] for n in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(s, pa.int64())], names=["q", "id", "score"])


def _block_top(spark, candidates: DataFrame, rows: list, longest: float, k: int) -> DataFrame:
    by_width: dict[int, list[int]] = {}
    for n, r in enumerate(rows):
        by_width.setdefault(len(r.x), []).append(n)
    ids = np.array([r.id for r in rows], np.int64)
    block = {w: (np.array(own), ids[own], np.array([rows[n].x for n in own], np.float64).reshape(len(own), w)) for w, own in by_width.items()}
    shared = spark.sparkContext.broadcast(block)
    # Cauchy-Schwarz bounds every score
    bound = [min(LIMIT, int(np.ceil(float(np.linalg.norm(np.array(r.x, np.float64))) * longest * 1.000001)) + 1) for r in rows]
    low = np.array([-b for b in bound], np.int64)
    width = np.array([1 << max(0, (2 * b).bit_length() - BINS.bit_length() + 1) for b in bound], np.int64)  # powers of two: a bin is parted evenly
    bins = np.full(len(rows), BINS, np.int64)
    above = np.zeros(len(rows), np.int64)
    least = np.full(len(rows), np.iinfo(np.int64).min)
    open_ = np.ones(len(rows), bool)
    while open_.any():
        now = low.copy(), width.copy(), bins.copy(), np.where(open_, above, k)
        counts = candidates.mapInArrow(lambda it, s=shared, a=now: _histogram(it, s.value, *a, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        higher = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        found = counts.withColumn("reached", higher).withColumn("before", higher - F.col("n"))
        need = spark.createDataFrame([(n, int(k - above[n])) for n in range(len(rows)) if open_[n]], "q int, need long")
        hits = {r.q: r for r in found.join(F.broadcast(need), "q").where("reached >= need and before < need").collect()}  # a row for each query of the block
        for n in np.flatnonzero(open_).tolist():
            r = hits.get(n)
            if r is None:  # fewer than k candidates: all of them
                open_[n] = False
                continue
            low[n] += r.bin * width[n]
            above[n] += r.before
            if width[n] == 1:
                least[n], open_[n] = low[n], False
            else:
                bins[n] = min(BINS, int(width[n]))
                width[n] //= bins[n]
    chosen = candidates.mapInArrow(lambda it, s=shared, t=least: _emit(it, s.value, t, k), "q int, id long, score long")
    names = spark.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "q int, query_id long")
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller id."""
    spark = vectors.sparkSession
    candidates = quantized(vectors, id_column, vector_column, scale)
    length = candidates.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))).alias("m")).first().m or 0.0
    out = None
    for rows in common.small_rows(quantized(queries, id_column, vector_column, scale), QUERY_BLOCK_BYTES, lambda r: 8 * len(r.x) + 8):
        part = _block_top(spark, candidates, rows, min(length, 1e150), k)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
