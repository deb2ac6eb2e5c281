"""Sorting, ranking, selection and prefix scans along an axis or over all elements.

Lanes up to planner.LANE elements are windows by lane. Longer ones are parted:
for a sort at sampled values, for a scan at fixed distances; the parts are
ordered within tasks, and small tables of their counts or sums carry over. No
lane is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array, ravelled, unravelled
from ..plans import planner

PARTS = 256


def positions(df: DataFrame, lanes: list[str], order: list[str], length: int) -> DataFrame:
    """df with ``at``, the number of each row in its lane by the order columns, from 0. length: of a lane, at most. The last order column must tell rows of a lane apart."""
    if length <= planner.LANE:
        w = Window.partitionBy(*lanes).orderBy(*order)
        return df.withColumn("at", (F.row_number().over(w) - 1).cast("long"))
    bounds = df.select(F.percentile_approx(order[0], [k / PARTS for k in range(1, PARTS)], 20 * PARTS)).first()[0] or []
    bounds = sorted(set(bounds))
    # values that are bounds have parts of their own, which a hash-free split by the last column spreads further
    span = df.agg(F.min(order[-1]), F.max(order[-1])).first()
    width = max(1, (span[1] - span[0] + 1) // PARTS) if len(order) > 1 and span[0] is not None else 1
    df = _parted(df, order[0], bounds)
    df = df.withColumn("__sub", F.when(F.col("__part") % 2 == 1, F.floor((F.col(order[-1]) - span[0]) / width)).otherwise(0).cast("long") if len(order) > 1 else F.lit(0).cast("long"))
    keys = [*lanes, "__part", "__sub"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*lanes).orderBy("__part", "__sub").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__inner", inner).join(counts if lanes else F.broadcast(counts), keys).withColumn("at", (F.col("__inner") + F.col("__before")).cast("long")).drop("__part", "__sub", "__inner", "__before")


def _parted(df: DataFrame, name: str, bounds: list, step: int = 16) -> DataFrame:
    """df with ``__part``: twice the number of bounds below the column's value, and one more where that is a bound. A row is compared with every 16th bound and then with 16 of them. Null is below all."""
    v, groups = F.col(name), [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if not bounds:
        return df.withColumn("__part", F.lit(0))
    below = lambda edges: F.size(F.filter(edges, lambda b: b < v))
    df = df.withColumn("__group", below(F.lit([g[-1] for g in groups])))
    df = df.withColumn("__own", F.coalesce(F.get(F.lit(groups), F.col("__group")), F.slice(F.lit(groups[0]), 1, 0)))
    on = F.coalesce(F.array_contains("__own", v), F.lit(False))
    return df.withColumn("__part", 2 * (F.least(step * F.col("__group"), F.lit(len(bounds))) + below(F.col("__own"))) + on.cast("int")).drop("__group", "__own")


def _ordered(x: GridArray, axis) -> tuple[DataFrame, int | None, list[str]]:
    x = x.dense()
    if axis is None:
        rows = x.frame().select(ravelled(x.coords, x.shape).alias("__p"), "v")
        return positions(rows, [], ["v", "__p"], x.size), None, []
    axis %= x.ndim
    lanes = [c for k, c in enumerate(x.coords) if k != axis]
    return positions(x.frame().withColumnRenamed(f"i{axis}", "__p"), lanes, ["v", "__p"], x.shape[axis]), axis, lanes


def sort(x, axis=-1, sample_rate=0.1) -> GridArray:
    """Along an axis; with axis None all elements, as a vector."""
    x = as_array(x)
    df, axis, _ = _ordered(x, axis)
    if axis is None:
        return GridArray(df.select(F.col("at").alias("i0"), "v"), (x.size,), x.dtype)
    return GridArray(df.withColumnRenamed("at", f"i{axis}").select(*x.coords, "v"), x.shape, x.dtype)


def argsort(x, axis=-1) -> GridArray:
    """The numbers of the elements in sorted order; equal ones in their own order."""
    x = as_array(x)
    df, axis, _ = _ordered(x, axis)
    if axis is None:
        return GridArray(df.select(F.col("at").alias("i0"), F.col("__p").alias("v")), (x.size,), "int64")
    return GridArray(df.withColumnRenamed("at", f"i{axis}").withColumn("v", F.col("__p")).select(*x.coords, "v"), x.shape, "int64")


def partition(x, kth, axis=-1) -> GridArray:
    """The kth element in its sorted place, smaller ones before it, others after it: a sorted lane is that."""
    return sort(x, axis)


def argpartition(x, kth, axis=-1) -> GridArray:
    return argsort(x, axis)


def topk(x, k: int, largest: bool = True) -> GridArray:
    """(…, 0..k-1) of the last axis: the numbers of the k largest (or smallest) elements of each lane, best first; of equal ones the first. A rank limit cuts each task's rows before the shuffle."""
    x = as_array(x).dense()
    lanes, last = x.coords[:-1], x.coords[-1]
    w = Window.partitionBy(*lanes).orderBy(F.desc("v") if largest else F.asc("v"), F.col(last))
    df = x.frame().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return GridArray(df.select(*lanes, (F.col("r") - 1).cast("long").alias(last), F.col(last).alias("v")), (*x.shape[:-1], min(k, x.shape[-1])), "int64")


_SCANS = {"sum": (F.sum, lambda a, b: a + b), "prod": (F.product, lambda a, b: a * b), "max": (F.max, F.greatest), "min": (F.min, F.least)}
_NAMES = {np.sum: "sum", np.cumsum: "sum", np.prod: "prod", np.cumprod: "prod", np.max: "max", np.min: "min", np.maximum.accumulate: "max", np.minimum.accumulate: "min", np.maximum: "max", np.minimum: "min"}


def _running(df: DataFrame, lanes: list[str], pos: str, length: int, agg, combine) -> DataFrame:
    """df (lanes, pos, v) with v replaced by the running aggregate along pos."""
    upto = Window.partitionBy(*lanes).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if length <= planner.LANE:
        return df.withColumn("v", agg("v").over(upto))
    step, chunk, carry = max(2, int(length**0.5)), f"{pos}_chunk", f"{pos}_carry"
    df = df.withColumn(chunk, F.call_function("div", F.col(pos), F.lit(step).cast("long")))
    chunks = df.groupBy(*lanes, chunk).agg(agg("v").alias("v"))
    chunks = _running(chunks, lanes, chunk, -(-length // step), agg, combine)
    carried = chunks.select(*lanes, (F.col(chunk) + 1).alias(chunk), F.col("v").alias(carry))
    own = Window.partitionBy(*lanes, chunk).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("v", agg("v").over(own)).join(carried, [*lanes, chunk], "left")
    return df.withColumn("v", F.when(F.col(carry).isNull(), F.col("v")).otherwise(combine(F.col("v"), F.col(carry)))).drop(chunk, carry)


def scan(x, reduce_fn=np.sum, scan_fn=np.cumsum, axis=None) -> GridArray:
    """Running sums, products, maxima or minima along an axis; with axis None in C order, in the same shape. Any other associative function: scan_fn=(aggregate of a column's name, function of two Columns)."""
    x = as_array(x).dense()
    agg, combine = scan_fn if isinstance(scan_fn, tuple) else _SCANS[_NAMES.get(scan_fn, scan_fn)]
    dtype = x.dtype if x.floating else "int64"
    kind = "double" if x.floating else "long"
    rows = x.frame().withColumn("v", F.col("v").cast(kind))
    if axis is None:
        rows = rows.select(ravelled(x.coords, x.shape).alias("__p"), "v")
        df = _running(rows, [], "__p", x.size, agg, combine).select(*unravelled(F.col("__p"), x.shape), "v")
    else:
        axis %= x.ndim
        df = _running(rows, [c for k, c in enumerate(x.coords) if k != axis], f"i{axis}", x.shape[axis], agg, combine)
    return GridArray(df.select(*x.coords, F.col("v").cast(SPARK_TYPES[dtype]).alias("v")), x.shape, dtype)


def lag(x: GridArray, distance: int = 1) -> tuple[GridArray, GridArray]:
    """A vector's elements and the ones so many elements before them, as two expressions over one relation; at the element's place less the distance, as x[distance:] and x[:-distance] where no place is left out. Places without a row, as in tables whose keys have gaps, are no elements."""
    n = x.size - distance
    placed = positions(x.dense().frame("a"), [], ["i0"], x.size)
    df = placed.join(placed.select((F.col("at") + distance).alias("at"), F.col("a").alias("b")), "at").select((F.col("i0") - distance).alias("i0"), "a", "b")
    return GridArray(df, (n,), x.dtype, "a"), GridArray(df, (n,), x.dtype, "b")
