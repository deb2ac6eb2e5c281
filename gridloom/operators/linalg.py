"""Products: joins on the inner axis, or dense blocks multiplied by NumPy."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array
from ..plans import planner


def dot(a, b, tile_hint=None) -> GridArray:
    """Vector by vector (of shape (1,)), matrix by vector, vector by matrix, matrix by matrix."""
    a = as_array(a)
    b = as_array(b, a.spark)
    if a.ndim == 1 and b.ndim == 2:
        out = dot(a.reshape(1, a.size), b)
        return out.reshape(b.shape[1])
    if not 1 <= a.ndim <= 2 or not 1 <= b.ndim <= 2 or a.shape[-1] != b.shape[0]:
        raise ValueError(f"{a.shape} and {b.shape} are not aligned")
    dtype = np.result_type(a.dtype, b.dtype).name
    dtype = "int64" if dtype in ("bool", "int32") else dtype
    wide = "double" if dtype.startswith("float") else "long"
    kind = SPARK_TYPES[dtype]
    if a.ndim == 2 and b.ndim == 2 and not a.sparse and not b.sparse and planner.dot_strategy(a.shape[0], a.shape[1], b.shape[1], False) == "block":
        return _thin_dot(a, b, dtype) if a.shape[0] <= THIN and b.shape[1] <= THIN else _block_dot(a, b, dtype)
    left = a.frame("va").withColumnRenamed(f"i{a.ndim - 1}", "k")
    right = b.frame("vb").select(F.col("i0").alias("k"), *([F.col("i1").alias("j")] if b.ndim == 2 else []), "vb")
    left, right = (F.broadcast(left), right) if planner.small(a) and a.size < b.size else (left, F.broadcast(right) if planner.small(b) else right)
    both = left.join(right, "k")
    total = F.sum(F.col("va").cast(wide) * F.col("vb").cast(wide)).cast(kind).alias("v")
    if a.ndim == 1:
        df = both.agg(total).select(F.lit(0).cast("long").alias("i0"), F.coalesce("v", F.lit(0)).cast(kind).alias("v"))
        return GridArray(df, (1,), dtype)
    keys = ["i0", "j"] if b.ndim == 2 else ["i0"]
    df = both.groupBy(*keys).agg(total)
    shape = (a.shape[0], b.shape[1]) if b.ndim == 2 else (a.shape[0],)
    return GridArray(df.select("i0", *([F.col("j").alias("i1")] if b.ndim == 2 else []), "v"), shape, dtype, "v", a.sparse or b.sparse)


def blocks(x: GridArray, size: int = planner.BLOCK) -> DataFrame:
    """(b0, b1, data): dense blocks as float64 bytes in C order, cut off at the array's edges. One shuffle by block."""
    n, m = x.shape
    cells = x.frame().select(F.call_function("div", "i0", F.lit(size).cast("long")).alias("b0"), F.call_function("div", "i1", F.lit(size).cast("long")).alias("b1"), (F.col("i0") % size).cast("int").alias("r"), (F.col("i1") % size).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    tasks = int(x.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(tasks, "b0", "b1").sortWithinPartitions("b0", "b1")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come block by block: one block is held at a time."""
        key, block = None, None
        for batch in batches:
            b0, b1, r, c, v = (batch.column(i).to_numpy() for i in range(5))
            edges = [0, *(np.flatnonzero((b0[1:] != b0[:-1]) | (b1[1:] != b1[:-1])) + 1).tolist(), len(b0)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                here = int(b0[lo]), int(b1[lo])
                if here != key:
                    if key is not None:
                        yield _one(key, block)
                    key, block = here, np.zeros((min(size, n - here[0] * size), min(size, m - here[1] * size)))
                block[r[lo:hi], c[lo:hi]] = v[lo:hi]
        if key is not None:
            yield _one(key, block)

    return dealt.mapInArrow(pack, "b0 long, b1 long, data binary")


def unblocked(df: DataFrame, n: int, m: int, size: int) -> DataFrame:
    """(i0, i1, v) of blocks (b0, b1, data)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b0, b1, data in zip(batch.column("b0").to_pylist(), batch.column("b1").to_pylist(), batch.column("data").to_pylist(), strict=True):
                wide = min(size, m - b1 * size)
                block = np.frombuffer(data).reshape(-1, wide)
                r, c = np.divmod(np.arange(block.size), wide)
                yield pa.RecordBatch.from_arrays([pa.array(b0 * size + r), pa.array(b1 * size + c), pa.array(block.ravel())], names=["i0", "i1", "v"])

    return df.mapInArrow(cells, "i0 long, i1 long, v double")


#: Rows and columns of a result that every task of a product along a long inner axis can hold (8 MB).
THIN = 1 << 10


def _thin_dot(a: GridArray, b: GridArray, dtype: str) -> GridArray:
    """A small result of a long inner axis: the elements of both sides go by slices of that axis to the tasks, each of which holds two slices and one sum, and sends that sum once."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    size = max(1, min(planner.BLOCK, (1 << 18) // max(n, m)))
    slices = lambda x, side, at, other: x.frame().select(F.call_function("div", at, F.lit(size).cast("long")).alias("s"), F.lit(side).alias("side"), (F.col(at) % size).cast("int").alias("k"), F.col(other).cast("int").alias("i"), F.col("v").cast("double").alias("v"))
    tasks = int(a.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slices(a, False, "i1", "i0").union(slices(b, True, "i0", "i1")).repartition(tasks, "s").sortWithinPartitions("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, here, x, y = np.zeros((n, m)), None, np.zeros((n, size)), np.zeros((size, m))
        for batch in batches:
            s, side, at, i, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if here is not None and here != s[lo]:
                    total += x @ y
                    x[:], y[:] = 0, 0
                here = s[lo]
                right = side[lo:hi]
                x[i[lo:hi][~right], at[lo:hi][~right]] = v[lo:hi][~right]
                y[at[lo:hi][right], i[lo:hi][right]] = v[lo:hi][right]
        if here is not None:
            total += x @ y
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i0", "i1", "v"])

    cells = dealt.mapInArrow(run, "i0 long, i1 long, v double").groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    return GridArray(cells.select("i0", "i1", F.col("v").cast(SPARK_TYPES[dtype]).alias("v")), (n, m), dtype)


def _block_dot(a: GridArray, b: GridArray, dtype: str, size: int = planner.BLOCK) -> GridArray:
    """Blocks meet on the inner block number. Those of one result block are added up by several tasks, BLOCKS_A_TASK products each, and their partial sums by SQL."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    left = blocks(a, size).select("b0", F.col("b1").alias("bk"), F.col("data").alias("a"))
    right = blocks(b, size).select(F.col("b0").alias("bk"), "b1", F.col("data").alias("b"))
    parts = left.join(right, "bk").withColumn("part", F.call_function("div", "bk", F.lit(planner.BLOCKS_A_TASK).cast("long")))
    tasks = int(a.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(tasks, "b0", "b1", "part").sortWithinPartitions("b0", "b1", "part")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("b0", "b1", "part", "bk", "a", "b")]
            for b0, b1, part, bk, x, y in zip(*cols, strict=True):
                inner = min(size, k - bk * size)
                product = np.frombuffer(x).reshape(-1, inner) @ np.frombuffer(y).reshape(inner, -1)
                if key == (b0, b1, part):
                    total += product
                else:
                    if key is not None:
                        yield _one(key, total)
                    key, total = (b0, b1, part), product
        if key is not None:
            yield _one(key, total)

    partial = dealt.mapInArrow(add_up, "b0 long, b1 long, data binary")
    cells = unblocked(partial, n, m, size)
    if k > size * planner.BLOCKS_A_TASK:
        cells = cells.groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    return GridArray(cells.select("i0", "i1", F.col("v").cast(SPARK_TYPES[dtype]).alias("v")), (n, m), dtype)


def _one(key: tuple, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.tobytes()], pa.binary())], names=["b0", "b1", "data"])


def rows(x: GridArray) -> DataFrame:
    """(i0, x): a matrix of few columns as one vector for each row."""
    if x.shape[1] > 1 << 16:
        raise ValueError("vectors of rows are for matrices of up to 65536 columns")
    packed = x.dense().frame().groupBy("i0").agg(F.sort_array(F.collect_list(F.struct("i1", "v"))).alias("cells"))
    return packed.select("i0", F.transform("cells", lambda c: c["v"].cast("double")).alias("x"))


def from_rows(df: DataFrame, shape: tuple[int, int]) -> GridArray:
    return GridArray(df.select("i0", F.posexplode("x").alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), "v"), shape)


def stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def gram(vectors: DataFrame, columns: list[str], widths: list[int]) -> np.ndarray:
    """XᵀX on the driver, X being the columns (vectors or numbers) side by side: every task returns one small matrix, SQL adds them up. The total width is bounded."""
    d = sum(widths)
    if d > 4096:
        raise ValueError("a Gram matrix on the driver is for up to 4096 columns")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = np.concatenate([stacked(batch.column(i), w) if pa.types.is_list(batch.column(i).type) else batch.column(i).to_numpy(zero_copy_only=False).reshape(-1, 1) for i, w in enumerate(widths)], 1).astype(np.float64)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((d, d))
    cells = vectors.select(*columns).mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    return out


#: Rows of a block of one side of an outer product.
OUTER = 256


def outer(a, b, fn, axes=(0, 0), dtype="float64", vectorized: bool = False) -> GridArray:
    """fn(va, vb) summed over the other axis for all pairs of rows (or elements of vectors): shape (rows of a, rows of b). Every row of a meets every row of b by definition; the smaller side is sent to the tasks of the larger one while it is small, and else the sides meet in blocks on the shared axis. vectorized: fn takes NumPy arrays, and blocks of whole rows meet without an element join; the elements of a pair of blocks are all that a task holds."""
    a, b = as_array(a).dense(), as_array(b).dense()
    if a.ndim == 1 and b.ndim == 1:
        right = b.frame("vb").withColumnRenamed("i0", "j")
        if vectorized:
            return outer(a.reshape(a.size, 1), b.reshape(b.size, 1), fn, (0, 0), dtype, True)
        df = a.frame("va").crossJoin(F.broadcast(right) if planner.small(b) else right).select("i0", F.col("j").alias("i1"), fn(F.col("va"), F.col("vb")).alias("v"))
        return GridArray(df, (a.size, b.size), dtype)
    left = a.frame("va").select(F.col(f"i{axes[0]}").alias("i0"), F.col(f"i{1 - axes[0]}").alias("k"), "va")
    right = b.frame("vb").select(F.col(f"i{axes[1]}").alias("j"), F.col(f"i{1 - axes[1]}").alias("k"), "vb")
    shape = a.shape[axes[0]], b.shape[axes[1]]
    if vectorized:
        return GridArray(_outer_blocks(left, right, fn, dtype, planner.small(b)), shape, dtype)
    df = left.join(F.broadcast(right) if planner.small(b) else right, "k").groupBy("i0", "j").agg(F.sum(fn(F.col("va"), F.col("vb"))).alias("v"))
    return GridArray(df.select("i0", F.col("j").alias("i1"), "v"), shape, dtype)


def _outer_blocks(left: DataFrame, right: DataFrame, fn, dtype: str, small: bool) -> DataFrame:
    tasks = max(4 * left.sparkSession.sparkContext.defaultParallelism, 1)
    packed = lambda df, key, value: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", value))).alias("c")).groupBy(F.call_function("div", key, F.lit(OUTER).cast("long")).alias("b")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.transform("c", lambda c: c["k"]).alias("k"), F.transform("c", lambda c: c[value].cast("double")).alias("x"))).alias("rows"))
    own, other = packed(left, "i0", "va"), packed(right, "j", "vb")
    own = own.select(F.col("rows").alias("p")).repartition(tasks)
    pairs = own.crossJoin(F.broadcast(other.select(F.col("rows").alias("q"))) if small else other.select(F.col("rows").alias("q")).repartition(tasks))
    kind = SPARK_TYPES[dtype]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(batch.column(0), batch.column(1), strict=True):
                x, y = _square(p.values), _square(q.values)
                for (i, k, x), (j, m, y) in itertools.product(x, y):
                    shared, at, to = np.intersect1d(k, m, return_indices=True)
                    if not len(shared):
                        continue
                    total = np.zeros((len(i), len(j)))
                    for s, t in zip(at, to, strict=True):
                        total += fn(x[:, s, None], y[None, :, t])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(total.ravel().astype(dtype))], names=["i0", "i1", "v"])

    return pairs.mapInArrow(run, f"i0 long, i1 long, v {kind}")


def _square(rows: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, places, values) of the rows that have the same places."""
    ids, lists, values = (rows.field(n) for n in ("id", "k", "x"))
    ids, lengths = ids.to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
    places, flat = lists.flatten().to_numpy(), values.flatten().to_numpy(zero_copy_only=False)
    out, ends = {}, np.cumsum(lengths)
    for row, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        out.setdefault(places[end - n : end].tobytes(), []).append((row, end - n, end))
    return [(ids[[r for r, _, _ in own]], places[own[0][1] : own[0][2]], np.array([flat[lo:hi] for _, lo, hi in own])) for own in out.values()]
