"""User functions over arrays.

A function of Columns stays in the projection. A NumPy function (vectorized=True)
gets Arrow batches as NumPy vectors, one for each array, and gives a vector of
the same length. Functions of tiles get whole dense blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array, coords, dtype_name
from ..session import kept
from . import elementwise


def _together(arrays) -> GridArray:
    """All arrays as columns a0, a1, ... of one relation."""
    arrays = elementwise.broadcast(arrays)
    first = arrays[0].dense()
    if all(a.df is first.df for a in arrays):
        df = first.df.select(*first.coords, *[a.value.alias(f"a{n}") for n, a in enumerate(arrays)])
    else:
        df = first.frame("a0")
        for n, a in enumerate(arrays[1:], 1):
            df = df.join(a.dense().frame(f"a{n}"), first.coords)
    return GridArray(df, first.shape, arrays[0].dtype, "a0")


def map(arrays, fn: Callable, dtype=None, vectorized: bool = False, fn_kw: dict | None = None, with_location: bool = False) -> GridArray:  # noqa: A001
    """fn of the arrays' elements. with_location: the coordinates follow as further arguments."""
    arrays = list(arrays) if isinstance(arrays, (list, tuple)) else [arrays]
    arrays = [as_array(a) for a in arrays]
    own, kw = _together(arrays), fn_kw or {}
    dtype = dtype_name(dtype or np.result_type(*[a.dtype for a in arrays]))
    kind = SPARK_TYPES[dtype]
    names = [f"a{n}" for n in range(len(arrays))]
    if not vectorized:
        v = fn(*[F.col(n) for n in names], *([F.col(c) for c in own.coords] if with_location else []), **kw)
        return GridArray(own.df, own.shape, dtype, v.cast(kind) if isinstance(v, Column) else F.lit(v).cast(kind))
    places = own.coords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            at = [batch.column(c).to_numpy() for c in places] if with_location else []
            out = np.asarray(fn(*values, *at, **kw)).astype(dtype)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in places), pa.array(np.broadcast_to(out, batch.num_rows))], names=[*places, "v"])

    schema = ", ".join([*(f"{c} long" for c in places), f"v {kind}"])
    return GridArray(own.df.mapInArrow(run, schema), own.shape, dtype)


def map_with_location(arrays, fn, dtype=None, vectorized=False, fn_kw=None) -> GridArray:
    return map(arrays, fn, dtype, vectorized, fn_kw, True)


def map2(arrays, axes, fn: Callable[..., tuple[list[Column], Column]], shape, dtype="float64", reducer: Callable[[str], Column] = F.sum) -> GridArray:
    """Two arrays joined on axes[0] of the one and axes[1] of the other. fn gets both sides' coordinates and values (lists of Columns, and Columns) and gives the result's coordinates and value; what meets in a cell is combined by the reducer."""
    a, b = (as_array(x) for x in arrays)
    left = a.frame("va").select(*[F.col(c).alias(f"a{k}") for k, c in enumerate(a.coords)], "va", F.col(f"i{axes[0]}").alias("__on"))
    right = b.frame("vb").select(*[F.col(c).alias(f"b{k}") for k, c in enumerate(b.coords)], "vb", F.col(f"i{axes[1]}").alias("__on"))
    place, value = fn([F.col(f"a{k}") for k in range(a.ndim)], F.col("va"), [F.col(f"b{k}") for k in range(b.ndim)], F.col("vb"))
    cells = left.join(right, "__on").select(*[p.cast("long").alias(f"i{k}") for k, p in enumerate(place)], value.alias("v"))
    return _combined(cells, shape, dtype, reducer)


def shuffle(x, fn: Callable[..., tuple[list[Column], Column]], shape, dtype="float64", reducer: Callable[[str], Column] = F.sum, sparse: bool = True) -> GridArray:
    """Elements sent to other places: fn gets the coordinates and the value, and gives new ones."""
    x = as_array(x)
    place, value = fn(*[F.col(c) for c in x.coords], F.col("v"))
    cells = x.frame().select(*[p.cast("long").alias(f"__i{k}") for k, p in enumerate(place)], value.alias("v"))
    cells = cells.select(*[F.col(f"__i{k}").alias(f"i{k}") for k in range(len(place))], "v")
    out = _combined(cells, shape, dtype, reducer)
    return out if sparse else out.dense()


def _combined(cells: DataFrame, shape, dtype, reducer) -> GridArray:
    names, dtype = coords(len(shape)), dtype_name(dtype)
    df = cells.groupBy(*names).agg(reducer("v").cast(SPARK_TYPES[dtype]).alias("v")) if names else cells.agg(reducer("v").cast(SPARK_TYPES[dtype]).alias("v"))
    return GridArray(df, tuple(shape), dtype, "v", True)


def tiles(x: GridArray, tile: tuple[int, ...]) -> DataFrame:
    """(t0, ..., data): dense tiles, as float64 bytes in C order, cut off at the edges."""
    x = as_array(x).dense()
    k, shape = x.ndim, x.shape
    cell = [F.col(c) % F.lit(t) for c, t in zip(x.coords, tile, strict=True)]
    rows = x.frame().select(*[F.call_function("div", c, F.lit(t).cast("long")).alias(f"t{n}") for n, (c, t) in enumerate(zip(x.coords, tile, strict=True))], F.struct(*[c.cast("int").alias(f"c{n}") for n, c in enumerate(cell)], F.col("v").cast("double").alias("v")).alias("cell"))
    packed = rows.groupBy(*[f"t{n}" for n in range(k)]).agg(F.collect_list("cell").alias("cells"))

    def pack(batches):
        for batch in batches:
            at = [batch.column(f"t{n}").to_pylist() for n in range(k)]
            out = []
            for i in range(batch.num_rows):
                own = batch.column("cells")[i].values
                block = np.zeros([min(t, s - at[n][i] * t) for n, (t, s) in enumerate(zip(tile, shape, strict=True))])
                block[tuple(own.field(n).to_numpy() for n in range(k))] = own.field(k).to_numpy()
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(f"t{n}") for n in range(k)), pa.array(out, pa.binary())], names=[*(f"t{n}" for n in range(k)), "data"])

    return packed.mapInArrow(pack, ", ".join([*(f"t{n} long" for n in range(k)), "data binary"]))


def map_tiles(x: GridArray, tile: tuple[int, ...], fn: Callable[[np.ndarray, tuple], np.ndarray]) -> GridArray:
    """fn(block, its first coordinates), which gives a block of the same shape."""
    x = as_array(x)
    k, shape, names = x.ndim, x.shape, x.coords

    def run(batches):
        for batch in batches:
            at = [batch.column(f"t{n}").to_pylist() for n in range(k)]
            for i, data in enumerate(batch.column("data").to_pylist()):
                first = tuple(at[n][i] * tile[n] for n in range(k))
                block = np.frombuffer(data).reshape([min(t, s - f) for t, s, f in zip(tile, shape, first, strict=True)])
                out = np.asarray(fn(block, first), np.float64)
                cell = np.indices(out.shape).reshape(k, -1)
                yield pa.RecordBatch.from_arrays([*(pa.array(c + f) for c, f in zip(cell, first, strict=True)), pa.array(out.ravel())], names=[*names, "v"])

    return GridArray(tiles(x, tile).mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "v double"])), shape)


def tile_operation(x: GridArray, tile: tuple[int, ...], fn: Callable[[np.ndarray, tuple], float]) -> DataFrame:
    """(t0, ..., value): a number for each tile."""
    x = as_array(x)
    k, shape = x.ndim, x.shape

    def run(batches):
        for batch in batches:
            at = [batch.column(f"t{n}").to_pylist() for n in range(k)]
            out = []
            for i, data in enumerate(batch.column("data").to_pylist()):
                first = tuple(at[n][i] * tile[n] for n in range(k))
                out.append(float(fn(np.frombuffer(data).reshape([min(t, s - f) for t, s, f in zip(tile, shape, first, strict=True)]), first)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"t{n}") for n in range(k)), pa.array(out, pa.float64())], names=[*(f"t{n}" for n in range(k)), "value"])

    return tiles(x, tile).mapInArrow(run, ", ".join([*(f"t{n} long" for n in range(k)), "value double"]))


def not_idempotent(operator: Callable[..., GridArray]) -> Callable[..., GridArray]:
    """For functions that may give other values when they run again (clocks, outside state): the array is written once, and every use reads that."""

    @functools.wraps(operator)
    def run(*args, **kw) -> GridArray:
        x = operator(*args, **kw)
        return GridArray(kept(x.frame()), x.shape, x.dtype, "v", x.sparse)

    return run
