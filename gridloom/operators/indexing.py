"""Slices, masks, gathers, assignment, and changes of shape: filters and arithmetic on coordinates."""

from __future__ import annotations

from math import prod

import numpy as np
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array, coords, ravelled, unravelled
from ..plans import planner
from . import elementwise


def _slices(index, shape: tuple[int, ...]):
    """For each axis an int or a slice of normal bounds; and where new axes come in."""
    index = index if isinstance(index, tuple) else (index,)
    given = sum(1 for x in index if x is not None and x is not Ellipsis)
    if given > len(shape):
        raise IndexError("more indices than axes")
    full = [slice(None)] * (len(shape) - given)
    at = index.index(Ellipsis) if Ellipsis in index else len(index)
    index = [*index[:at], *full, *index[at + 1 :]]
    out, axis = [], 0
    for x in index:
        if x is None:
            out.append(None)
            continue
        n = shape[axis]
        axis += 1
        if isinstance(x, slice):
            out.append(range(*x.indices(n)))
        else:
            k = int(x)
            if not -n <= k < n:
                raise IndexError(f"index {k} of an axis of {n}")
            out.append(k % n)
    return out


def getitem(x: GridArray, index) -> GridArray:
    if isinstance(index, GridArray):
        return mask(x, index) if index.dtype == "bool" else take(x, index)
    if isinstance(index, (list, np.ndarray)) and np.ndim(index):
        index = np.asarray(index)
        return mask(x, as_array(index, x.spark)) if index.dtype == bool else take(x, as_array(index, x.spark))
    parts = _slices(index, x.shape)
    df, shape, names, axis = x.frame(), [], [], 0
    for part in parts:
        if part is None:
            names.append(F.lit(0).cast("long"))
            shape.append(1)
            continue
        c = F.col(f"i{axis}")
        axis += 1
        if isinstance(part, int):
            df = df.where(c == part)
        else:
            n = len(part)
            low, high = (min(part[0], part[-1]), max(part[0], part[-1])) if n else (1, 0)
            df = df.where((c >= low) & (c <= high)) if n < x.shape[axis - 1] or not n else df
            if abs(part.step) != 1:
                df = df.where((c - part.start) % part.step == 0)
            names.append(F.call_function("div", c - part.start, F.lit(part.step).cast("long")))
            shape.append(n)
    return GridArray(df.select(*[n.alias(f"i{k}") for k, n in enumerate(names)], "v"), tuple(shape), x.dtype, "v", x.sparse)


def mask(x: GridArray, chosen: GridArray) -> GridArray:
    """The elements where the mask is true, in C order, as a vector. Its length takes a count."""
    x, m = elementwise.joined(x.dense(), chosen.dense())
    picked = x.df.select(ravelled(x.coords, x.shape).alias("p"), x.value.alias("v")).where(m.value)
    from .sorting import positions

    picked = picked.persist()
    n = picked.count()
    return GridArray(positions(picked, [], ["p"], n).select(F.col("at").alias("i0"), "v"), (n,), x.dtype)


def masked(x: GridArray, chosen: GridArray) -> GridArray:
    """The elements where the mask is true, at their own places; the others are left out."""
    x, m = elementwise.joined(x.dense(), chosen.dense())
    return GridArray(x.df.where(m.value), x.shape, x.dtype, x.value, True)


def take(x: GridArray, index: GridArray) -> GridArray:
    """Rows by their numbers, which may repeat and come in any order; negative ones count from the end."""
    if index.ndim != 1:
        raise NotImplementedError("index arrays of one axis only")
    own = index.dense().frame("__k").select(F.col("i0").alias("__to"), F.when(F.col("__k") < 0, F.col("__k") + x.shape[0]).otherwise(F.col("__k")).cast("long").alias("i0"))
    df = x.frame().join(F.broadcast(own) if planner.small(index) else own, "i0")
    return GridArray(df.select(F.col("__to").alias("i0"), *x.coords[1:], "v"), (index.size, *x.shape[1:]), x.dtype, "v", x.sparse)


def _region(x: GridArray, index):
    """The condition that an element lies in the region, its parts, and the region's shape without int axes."""
    parts = _slices(index, x.shape)
    inside, shape = F.lit(True), []
    for k, part in enumerate(parts):
        c = F.col(f"i{k}")
        if isinstance(part, int):
            inside = inside & (c == part)
        elif len(part):
            inside = inside & (c >= min(part[0], part[-1])) & (c <= max(part[0], part[-1])) & ((c - part.start) % part.step == 0)
            shape.append(len(part))
        else:
            inside = F.lit(False)
            shape.append(0)
    return inside, parts, tuple(shape)


def assign(x, index, value) -> GridArray:
    """A new array that differs from x in x[index] = value."""
    x = as_array(x).dense()
    kind = SPARK_TYPES[x.dtype]
    inside, parts, shape = _region(x, index)
    if not isinstance(value, GridArray) and np.ndim(value) == 0:
        return GridArray(x.df, x.shape, x.dtype, F.when(inside, F.lit(value).cast(kind)).otherwise(x.value.cast(kind)))
    value = as_array(value, x.spark)
    value = (value if value.shape == shape else elementwise.broadcast_to(value, shape)).dense()
    place, axis = [], 0
    for part in parts:
        if isinstance(part, int):
            place.append(F.lit(part).cast("long"))
        else:
            place.append((F.col(f"i{axis}") * part.step + part.start).cast("long"))
            axis += 1
    new = value.frame("__new").select(*[p.alias(f"i{k}") for k, p in enumerate(place)], "__new")
    df = x.frame().join(F.broadcast(new) if planner.small(value) else new, x.coords, "left")
    return GridArray(df.select(*x.coords, F.when(inside, F.col("__new").cast(kind)).otherwise(F.col("v")).alias("v")), x.shape, x.dtype)


def write(x, src_slices, data, dst_slices=None, reducer=None) -> GridArray:
    """x with x[src_slices] = data[dst_slices]; a reducer (two Columns to one), if not given that of ndarray(), combines it with what was there and stays with the result."""
    reducer = reducer or getattr(x, "reduce_fn", None)
    data = as_array(data)
    data = data if dst_slices is None else data[dst_slices]
    if reducer is None:
        return assign(x, src_slices, data)
    x = as_array(x).dense()
    placed = assign(GridArray(x.df, x.shape, x.dtype, F.lit(None).cast(SPARK_TYPES[x.dtype])), src_slices, data)
    a, b = elementwise.joined(x, placed)
    out = GridArray(a.df, x.shape, x.dtype, F.when(b.value.isNull(), a.value).otherwise(reducer(a.value, b.value)))
    out.reduce_fn = reducer
    return out


def region_map(x, regions, fn) -> GridArray:
    """fn (a Column to a Column) inside the regions, nothing outside. A region: an index, or a list of them."""
    x = as_array(x).dense()
    regions = regions if isinstance(regions, list) else [regions]
    inside = F.lit(False)
    for r in regions:
        inside = inside | _region(x, r)[0]
    kind = SPARK_TYPES[x.dtype]
    return GridArray(x.df, x.shape, x.dtype, F.when(inside, fn(x.value).cast(kind)).otherwise(x.value.cast(kind)))


def reshape(x, *shape) -> GridArray:
    """Another shape of as many elements, in C order: a projection."""
    x = as_array(x)
    shape = tuple(shape[0]) if len(shape) == 1 and not isinstance(shape[0], (int, np.integer)) else tuple(shape)
    if -1 in shape:
        rest = prod(s for s in shape if s != -1)
        shape = tuple(x.size // max(rest, 1) if s == -1 else s for s in shape)
    if prod(shape) != x.size:
        raise ValueError(f"{x.shape} can't take the shape {shape}")
    df = x.frame().withColumn("__p", ravelled(x.coords, x.shape))
    return GridArray(df.select(*unravelled(F.col("__p"), shape), "v"), shape, x.dtype, "v", x.sparse)


def ravel(x) -> GridArray:
    x = as_array(x)
    return reshape(x, x.size)


def transpose(x, tile_hint=None) -> GridArray:
    x = as_array(x)
    names = x.coords[::-1]
    return GridArray(x.frame().select(*[F.col(n).alias(f"i{k}") for k, n in enumerate(names)], "v"), x.shape[::-1], x.dtype, "v", x.sparse)


def concatenate(a, b, axis=0) -> GridArray:
    a, b = as_array(a), as_array(b)
    if a.ndim != b.ndim or any(p != q for k, (p, q) in enumerate(zip(a.shape, b.shape)) if k != axis):
        raise ValueError(f"{a.shape} and {b.shape} can't be joined along axis {axis}")
    dtype = np.result_type(a.dtype, b.dtype).name
    sparse = a.sparse and b.sparse
    a, b = (a, b) if sparse else (a.dense(), b.dense())
    moved = b.astype(dtype).frame().withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(a.shape[axis]).cast("long"))
    shape = tuple(s + (b.shape[k] if k == axis else 0) for k, s in enumerate(a.shape))
    return GridArray(a.astype(dtype).frame().unionByName(moved), shape, dtype, "v", sparse)


def retile(x, tile_hint) -> GridArray:
    """The same array, its rows dealt by the tile they lie in; as many partitions as tiles, within what the session sets."""
    x = as_array(x)
    tiles = [F.call_function("div", F.col(f"i{k}"), F.lit(int(t)).cast("long")) for k, t in enumerate(tile_hint)]
    number = prod(-(-s // int(t)) for s, t in zip(x.shape, tile_hint, strict=True))
    n = max(1, min(number, int(x.spark.conf.get("spark.sql.shuffle.partitions"))))
    return GridArray(x.frame().repartition(n, *tiles), x.shape, x.dtype, "v", x.sparse)
