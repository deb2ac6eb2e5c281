"""New arrays: arithmetic on a distributed range, without input or shuffle."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array, coords, dtype_name, grid_frame, ravelled, session


def _shape(shape) -> tuple[int, ...]:
    return (int(shape),) if np.ndim(shape) == 0 else tuple(int(s) for s in shape)


def _filled(shape, value: Column, dtype) -> GridArray:
    shape, dtype = _shape(shape), dtype_name(dtype)
    return GridArray(grid_frame(session(), shape), shape, dtype, value.cast(SPARK_TYPES[dtype]))


def full(shape, fill_value, dtype=np.float32, tile_hint=None):
    return _filled(shape, F.lit(fill_value), dtype)


def zeros(shape, dtype=np.float32, tile_hint=None):
    return full(shape, 0, dtype)


def ones(shape, dtype=np.float32, tile_hint=None):
    return full(shape, 1, dtype)


def empty(shape, dtype=np.float32, tile_hint=None):
    """Zeros: there is no memory to leave as it was."""
    return full(shape, 0, dtype)


def sparse_empty(shape, dtype=np.float32, tile_hint=None):
    shape, dtype = _shape(shape), dtype_name(dtype)
    df = session().createDataFrame([], ", ".join([*(f"{c} long" for c in coords(len(shape))), f"v {SPARK_TYPES[dtype]}"]))
    return GridArray(df, shape, dtype, "v", True)


def ndarray(shape, dtype=np.float64, tile_hint=None, reduce_fn=None, sparse=False):
    """A place to write to; reduce_fn (two Columns to one) is how write() combines what meets in a cell."""
    out = sparse_empty(shape, dtype) if sparse else full(shape, 0, dtype)
    out.reduce_fn = reduce_fn
    return out


def full_like(x, fill_value, dtype=None, tile_hint=None):
    x = as_array(x)
    return full(x.shape, fill_value, dtype or x.dtype)


def zeros_like(x, dtype=None, tile_hint=None):
    return full_like(x, 0, dtype)


def ones_like(x, dtype=None, tile_hint=None):
    return full_like(x, 1, dtype)


def empty_like(x, dtype=None, tile_hint=None):
    return full_like(x, 0, dtype)


def eye(n, m=None, k=0, dtype=np.float32, tile_hint=None):
    return _filled((n, m or n), F.when(F.col("i1") == F.col("i0") + k, 1).otherwise(0), dtype)


def identity(n, dtype=np.float32, tile_hint=None):
    return eye(n, dtype=dtype)


def sparse_diagonal(shape, dtype=np.float32, tile_hint=None):
    shape, dtype = _shape(shape), dtype_name(dtype)
    df = session().range(min(shape)).select(*[F.col("id").alias(c) for c in coords(len(shape))])
    return GridArray(df, shape, dtype, F.lit(1).cast(SPARK_TYPES[dtype]), True)


def arange(start=None, stop=None, step=1, dtype=np.float64, tile_hint=None):
    """arange(stop), arange(start, stop, step), or arange(shape, start-less): with a tuple, the positions in C order times the step."""
    if start is None and stop is None:
        raise ValueError("arange takes a shape or a stop")
    if isinstance(start, (tuple, list)):
        if stop is not None:
            first = stop
        else:
            first = 0
        shape = _shape(start)
        return _filled(shape, F.lit(first) + F.lit(step) * ravelled(coords(len(shape)), shape), dtype)
    if stop is None:
        start, stop = 0, start
    start = 0 if start is None else start
    n = max(0, ceil((stop - start) / step))
    return _filled((n,), F.lit(start) + F.lit(step) * F.col("i0"), dtype)


def diagflat(x):
    x = as_array(x).ravel()
    n = x.size
    df = x.frame().select("i0", F.col("i0").alias("i1"), "v")
    return GridArray(df, (n, n), x.dtype, "v", True).dense()


def diagonal(x):
    x = as_array(x)
    if x.ndim != 2:
        raise ValueError("diagonal takes a matrix")
    df = x.frame().where("i0 = i1").select("i0", "v")
    return GridArray(df, (min(x.shape),), x.dtype, "v", x.sparse).dense()


def diag(x, offset=0):
    if offset:
        raise NotImplementedError("diag of another diagonal than the main one")
    x = as_array(x)
    return diagflat(x) if x.ndim == 1 else diagonal(x)


_seed = [42]


def set_random_seed(seed: int = 42) -> None:
    """The seed of the next random array; every further one takes the next number."""
    _seed[0] = seed


def _uniform(n_columns: int = 1, seed=None) -> list[Column]:
    """Random numbers in [0, 1) that depend on the seed and the element only: a task that runs again gives the same."""
    if seed is None:
        seed, _seed[0] = _seed[0], _seed[0] + 1
    return [(F.shiftrightunsigned(F.xxhash64(F.lit(seed * 16 + k), "__at"), 11).cast("double") / float(1 << 53)) for k in range(n_columns)]


def _random(shape, dtype, make) -> GridArray:
    shape = _shape(shape[0] if len(shape) == 1 else shape)
    df = grid_frame(session(), shape).withColumn("__at", ravelled(coords(len(shape)), shape))
    return GridArray(df.select(*coords(len(shape)), make().alias("v")), shape, dtype)


def rand(*shape, seed=None, **kw):
    return _random(shape, "float64", lambda: _uniform(1, seed)[0])


def randn(*shape, seed=None, **kw):
    def normal():
        a, b = _uniform(2, seed)
        return F.sqrt(-2.0 * F.ln(1.0 - a)) * F.cos(2.0 * np.pi * b)

    return _random(shape, "float64", normal)


def randint(*shape, low=0, high=10, seed=None, **kw):
    return _random(shape, "int64", lambda: (F.floor(_uniform(1, seed)[0] * (high - low)) + low).cast("long"))


def sparse_rand(shape, density=0.001, format="coo", dtype=np.float32, tile_hint=None, seed=None):  # noqa: A002
    """About density of all elements, uniform in [0, 1): random positions, of which equal ones count once."""
    shape, dtype = _shape(shape), dtype_name(dtype)
    total = int(np.prod([float(s) for s in shape]))
    n = int(round(total * density))
    a, b = _uniform(2, seed)
    df = session().range(n).withColumnRenamed("id", "__at").select(F.floor(a * total).cast("long").alias("p"), b.alias("v"))
    from ..array import unravelled

    df = df.groupBy("p").agg(F.min("v").alias("v")).select(*unravelled(F.col("p"), shape), F.col("v").cast(SPARK_TYPES[dtype]).alias("v"))
    return GridArray(df, shape, dtype, "v", True)
