"""Image operators on arrays (images, channels, width, height)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..array import GridArray, as_array
from ..plans import planner


def stencil(images, filters, stride: int = 1) -> GridArray:
    """Cross-correlation with (filters, channels, w, h), zeros beyond the right and lower edges: (images, filters, ceil(w / stride), ceil(h / stride)). Every element goes to the outputs it reaches by a join with the filters, which are broadcast while small; sums are partial first."""
    x, f = as_array(images), as_array(filters)
    if x.ndim != 4 or f.ndim != 4 or x.shape[1] != f.shape[1]:
        raise ValueError("stencil takes (n, c, w, h) and (f, c, w, h)")
    n, _, w, h = x.shape
    shape = (n, f.shape[0], -(-w // stride), -(-h // stride))
    taps = f.frame("vf").select(F.col("i0").alias("f"), F.col("i1").alias("c"), F.col("i2").alias("dx"), F.col("i3").alias("dy"), F.col("vf").cast("double").alias("vf"))
    taps = F.broadcast(taps) if planner.small(f) else taps
    cells = x.frame().select("i0", F.col("i1").alias("c"), "i2", "i3", F.col("v").cast("double").alias("v")).join(taps, "c")
    cells = cells.select("i0", F.col("f").alias("i1"), (F.col("i2") - F.col("dx")).alias("x"), (F.col("i3") - F.col("dy")).alias("y"), (F.col("v") * F.col("vf")).alias("p")).where("x >= 0 and y >= 0")
    if stride > 1:
        cells = cells.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))
    to = lambda c: F.call_function("div", c, F.lit(stride).cast("long"))
    df = cells.groupBy("i0", "i1", to("x").alias("i2"), to("y").alias("i3")).agg(F.sum("p").alias("v"))
    out = GridArray(df, shape, "float64", "v", True)
    return out.dense() if x.sparse or f.sparse else GridArray(df, shape, "float64")


def maxpool(images, pool_size: int = 2, stride: int = 2) -> GridArray:
    """The largest element of each window of pool_size, every stride elements; windows end at the edges."""
    x = as_array(images).dense()
    n, c, w, h = x.shape
    shape = (n, c, -(-w // stride), -(-h // stride))
    df = x.frame()
    for name, out, size in (("i2", "o2", shape[2]), ("i3", "o3", shape[3])):
        last = F.least(F.call_function("div", name, F.lit(stride).cast("long")), F.lit(size - 1).cast("long"))
        first = F.greatest(F.ceil((F.col(name) - (pool_size - 1)) / stride).cast("long"), F.lit(0).cast("long"))
        if pool_size == stride:
            df = df.withColumn(out, F.call_function("div", name, F.lit(stride).cast("long")))
        else:
            df = df.where(first <= last).withColumn(out, F.explode(F.sequence(first, last)))
    df = df.groupBy("i0", "i1", F.col("o2").alias("i2"), F.col("o3").alias("i3")).agg(F.max("v").alias("v"))
    return GridArray(df, shape, x.dtype)


def convnet(images, layers) -> GridArray:
    """Alternating stencils and pools: a list of filter arrays."""
    x = as_array(images)
    for f in layers:
        x = maxpool(stencil(x, f))
    return x


