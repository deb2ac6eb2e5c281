"""Reductions along one axis or over all elements: partial aggregation in every task, then a final one.

Sparse arrays count their unstored zeros by arithmetic on the number of stored
elements; results are dense.
"""

from __future__ import annotations

import builtins

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array, coords, grid_frame, ravelled
from . import elementwise

METHODS = ("sum", "prod", "max", "min", "mean", "std", "all", "any", "argmin", "argmax", "count_nonzero", "count_zero")


def _axis(x: GridArray, axis):
    if axis is None:
        return None
    if not -x.ndim <= axis < x.ndim:
        raise ValueError(f"axis {axis} of an array of {x.ndim} axes")
    return axis % x.ndim


def _grouped(x: GridArray, axis: int | None, *aggregates: Column) -> tuple[DataFrame, tuple[int, ...], int]:
    """The aggregates of each lane by the coordinates of the result; its shape; the lane's length."""
    rest = [n for k, n in enumerate(x.coords) if axis is not None and k != axis]
    df = x.frame().groupBy(*rest).agg(*aggregates) if rest else x.frame().agg(*aggregates)
    df = df.select(*[F.col(n).alias(f"i{k}") for k, n in enumerate(rest)], *[c for c in df.columns if c not in rest])
    shape = tuple(s for k, s in enumerate(x.shape) if axis is not None and k != axis)
    return df, shape, x.size if axis is None else x.shape[axis]


def _folded(x, axis, dtype: str, stored: Column, whole) -> GridArray:
    """stored: the aggregate of stored elements; whole(stored, missing): the result, given how many zeros aren't stored."""
    x = as_array(x)
    axis = _axis(x, axis)
    df, shape, length = _grouped(x, axis, stored.alias("a"), F.count("*").alias("n"))
    if x.sparse and shape:
        df = grid_frame(x.spark, shape).join(df, coords(len(shape)), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    missing = F.lit(length) - F.col("n") if x.sparse else None
    value = (whole(F.col("a"), missing) if whole else F.col("a")).cast(SPARK_TYPES[dtype])
    return GridArray(df.select(*coords(len(shape)), value.alias("v")), shape, dtype)


def _sum_type(x) -> str:
    return "int64" if not x.floating else x.dtype


def _number(x: GridArray) -> Column:
    return F.col("v").cast("double" if x.floating else "long")


def sum(x, axis=None, tile_hint=None):  # noqa: A001
    x = as_array(x)
    return _folded(x, axis, _sum_type(x), F.sum(_number(x)), lambda a, m: F.coalesce(a, F.lit(0)))


def prod(x, axis=None, tile_hint=None):
    """Of whole numbers exact up to 2**53."""
    x = as_array(x)
    return _folded(x, axis, _sum_type(x), F.product(F.col("v").cast("double")), lambda a, m: F.coalesce(a, F.lit(1.0)) if m is None else F.when(m > 0, 0.0).otherwise(a))


def _extreme(x, axis, pick, agg):
    x = as_array(x)
    zero = F.lit(0).cast(SPARK_TYPES[x.dtype])
    whole = lambda a, m: a if m is None else F.when(m > 0, pick(F.coalesce(a, zero), zero)).otherwise(a)
    return _folded(x, axis, x.dtype, agg, whole)


def max(x, axis=None, tile_hint=None):  # noqa: A001
    return _extreme(x, axis, F.greatest, F.max("v"))


def min(x, axis=None, tile_hint=None):  # noqa: A001
    """NaN if there is one, as for max; Spark alone would pass over it."""
    x = as_array(x)
    agg = F.min("v")
    if x.floating:
        agg = F.when(F.max(F.isnan("v")), F.lit(float("nan")).cast(SPARK_TYPES[x.dtype])).otherwise(agg)
    return _extreme(x, axis, F.least, agg)


def mean(x, axis=None):
    x = as_array(x)
    n = x.size if axis is None else x.shape[_axis(x, axis)]
    total = sum(x.astype("float64") if not x.floating else x, axis)
    return GridArray(total.df, total.shape, "float64", total.value.cast("double") / F.lit(float(builtins.max(n, 1))))


def std(x, axis=None):
    """The population's."""
    x = as_array(x)
    if not x.sparse:
        return _folded(x, axis, "float64", F.stddev_pop(F.col("v").cast("double")), None)
    moments = F.struct(F.sum(F.col("v").cast("double")).alias("s"), F.sum(F.col("v").cast("double") * F.col("v")).alias("q"), F.count("*").alias("k"))

    def whole(a, m):
        n = m + F.coalesce(a["k"], F.lit(0))
        average = F.coalesce(a["s"], F.lit(0.0)) / n
        return F.sqrt(F.greatest(F.coalesce(a["q"], F.lit(0.0)) / n - average * average, F.lit(0.0)))

    return _folded(x, axis, "float64", moments, whole)


def _true() -> Column:
    return elementwise.truth(F.col("v"))


def all(x, axis=None):  # noqa: A001
    return _folded(x, axis, "bool", F.bool_and(_true()), lambda a, m: F.coalesce(a, F.lit(True)) if m is None else F.coalesce(a, F.lit(True)) & (m == 0))


def any(x, axis=None):  # noqa: A001
    return _folded(x, axis, "bool", F.bool_or(_true()), lambda a, m: F.coalesce(a, F.lit(False)))


def count_nonzero(x, axis=None, tile_hint=None):
    return _folded(x, axis, "int64", F.count_if(_true()), lambda a, m: F.coalesce(a, F.lit(0)))


def count_zero(x, axis=None):
    return _folded(x, axis, "int64", F.count_if(~_true()), lambda a, m: F.coalesce(a, F.lit(0)) if m is None else F.coalesce(a, F.lit(0)) + m)


def _arg(x, axis, largest: bool) -> GridArray:
    """The first position of the extreme element; a NaN is the extreme."""
    x = as_array(x).dense()
    axis = _axis(x, axis)
    at = ravelled(x.coords, x.shape) if axis is None else F.col(f"i{axis}")
    if largest:
        found = F.max_by(at, F.struct(F.col("v"), -at))
    else:
        found = F.min_by(at, F.struct(~F.isnan(F.col("v").cast("double")), F.col("v"), at))
    df, shape, _ = _grouped(x, axis, found.cast("long").alias("v"))
    return GridArray(df, shape, "int64")


def argmax(x, axis=None):
    return _arg(x, axis, True)


def argmin(x, axis=None):
    return _arg(x, axis, False)


def bincount(x, weights=None, minlength: int | None = None):
    """How often each whole number occurs (or the sum of its weights), from 0 to the largest one."""
    x = as_array(x)
    top = x.dense().frame().agg(F.max("v"), F.min("v")).first()
    if top[1] is not None and top[1] < 0:
        raise ValueError("bincount takes no negative numbers")
    length = builtins.max((top[0] if top[0] is not None else -1) + 1, minlength or 0)
    if weights is None:
        df, dtype = x.dense().frame().groupBy(F.col("v").cast("long").alias("i0")).agg(F.count("*").alias("n")), "int64"
    else:
        a, w = elementwise.joined(x.dense(), as_array(weights).dense())
        df, dtype = a.df.groupBy(a.value.cast("long").alias("i0")).agg(F.sum(w.value.cast("double")).alias("n")), "float64"
    full = grid_frame(x.spark, (length,)).join(df, "i0", "left").select("i0", F.coalesce("n", F.lit(0)).cast(SPARK_TYPES[dtype]).alias("v"))
    return GridArray(full, (length,), dtype)


def normalize(x, axis=None):
    """Elements over the sum of their lane along the axis, or over all."""
    from .elementwise import true_divide

    x = as_array(x)
    total = sum(x, axis)
    if axis is not None:
        k = _axis(x, axis)
        names = [f"i{n}" if n < k else f"i{n + 1}" for n in range(total.ndim)]
        df = total.frame().select(*[F.col(f"i{n}").alias(m) for n, m in enumerate(names)], F.lit(0).cast("long").alias(f"i{k}"), "v")
        total = GridArray(df, x.shape[:k] + (1,) + x.shape[k + 1 :], total.dtype)
    if x.sparse:
        a, b = elementwise.joined(x, total)
        return GridArray(a.df, x.shape, "float64", elementwise.numeric.true_div(a.value, b.value), True)
    return true_divide(x, total)


def norm(x, ord: int = 2) -> float:  # noqa: A002
    """ord 1: the sum of magnitudes of a vector, the largest column's of a matrix; ord 2: of a vector, or of all elements."""
    x = as_array(x)
    if ord == 1:
        columns = sum(elementwise.abs(x), 0) if x.ndim > 1 else sum(elementwise.abs(x))
        return float(max(columns).glom())
    if ord != 2:
        raise ValueError("norms of order 1 and 2 only")
    return float(np.sqrt(float(sum(elementwise.square(x.astype("float64"))).glom())))


def reduce(x, axis, dtype, local, accumulate=None):
    """A reduction of one's own. local: a Column function, as F.max; or a NumPy function of the elements of a part of a lane, with accumulate to combine two partial results (both associative and commutative)."""
    x = as_array(x)
    if accumulate is None:
        return _folded(x.dense(), axis, np.dtype(dtype).name, local("v"), None)
    import pyarrow as pa

    x, kind = x.dense(), SPARK_TYPES[np.dtype(dtype).name]
    axis = _axis(x, axis)
    rest = [n for k, n in enumerate(x.coords) if axis is not None and k != axis]
    names = coords(len(rest))
    rows = x.frame().select(*[F.col(n).alias(m) for n, m in zip(rest, names, strict=True)], "v")

    def lanes(batch, fn):
        """(key, fn of the values) of the runs of rows of one lane."""
        keys = [batch.column(n).to_numpy() for n in names]
        v = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        starts = np.zeros(len(v), bool)
        starts[:1] = True
        for key in keys:
            starts[1:] |= key[1:] != key[:-1]
        edges = [*np.flatnonzero(starts).tolist(), len(v)]
        return [(tuple(int(key[lo]) for key in keys), fn(v[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]

    def packed(found):
        return pa.RecordBatch.from_arrays([*(pa.array([key[n] for key, _ in found], pa.int64()) for n in range(len(names))), pa.array([v for _, v in found], pa.from_numpy_dtype(np.dtype(dtype)))], names=[*names, "v"])

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                order = np.lexsort([batch.column(n).to_numpy() for n in names[::-1]]) if names else None
                ordered = batch if order is None or (order[1:] > order[:-1]).all() else batch.take(pa.array(order))
                yield packed(lanes(ordered, local))

    def final(batches):
        """Parts of a lane come one after the other; one total is held at a time."""
        key, total = None, None
        for batch in batches:
            found = []
            for here, parts in lanes(batch, lambda v: v.tolist()):
                for v in parts:
                    if key == here:
                        total = accumulate(total, v)
                    else:
                        if key is not None:
                            found.append((key, total))
                        key, total = here, v
            if found:
                yield packed(found)
        if key is not None:
            yield packed([(key, total)])

    schema = ", ".join([*(f"{n} long" for n in names), f"v {kind}"])
    parts = rows.mapInArrow(partial, schema)
    # partial results of a lane: one for each batch that holds it
    tasks = int(x.spark.conf.get("spark.sql.shuffle.partitions"))
    met = parts.repartition(tasks, *names).sortWithinPartitions(*names) if names else parts.coalesce(1)
    return GridArray(met.mapInArrow(final, schema), tuple(s for k, s in enumerate(x.shape) if axis is not None and k != axis), dtype)
