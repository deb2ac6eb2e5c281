"""Maps over elements: projections, or joins on coordinates where the operands are different relations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array, coords, dtype_name
from ..functions import numeric
from ..plans import planner


def broadcast_shape(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """NumPy's rule; ValueError where shapes don't fit."""
    return np.broadcast_shapes(a, b)


def stretched(x: GridArray, shape: tuple[int, ...]) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(own coordinate, coordinate in shape) of the axes that x spans, and the sizes of those along which it repeats."""
    shift = len(shape) - x.ndim
    kept = [(f"i{k}", f"i{k + shift}") for k in range(x.ndim) if x.shape[k] == shape[k + shift]]
    spanned = {n for _, n in kept}
    return kept, {f"i{k}": shape[k] for k in range(len(shape)) if f"i{k}" not in spanned}


def broadcast_to(x: GridArray, shape: tuple[int, ...]) -> GridArray:
    """x repeated along new and size-1 axes, by generating the missing coordinates of each row."""
    kept, missing = stretched(x, shape)
    df = x.dense().frame()
    df = df.select(*[F.col(a).alias(b) for a, b in kept], "v")
    for name, size in missing.items():
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return GridArray(df.select(*coords(len(shape)), "v"), shape, x.dtype)


def broadcast(arrays) -> list[GridArray]:
    """All arrays in their common shape."""
    arrays = [as_array(a) for a in arrays]
    shape = np.broadcast_shapes(*[a.shape for a in arrays])
    return [a if a.shape == shape else broadcast_to(a, shape) for a in arrays]


def joined(a: GridArray, b: GridArray, how: str = "inner") -> tuple[GridArray, GridArray]:
    """Both as expressions over one relation. how: of which elements both need a stored value (inner, outer)."""
    if a.df is b.df and a.shape == b.shape:
        return a, b
    shape = broadcast_shape(a.shape, b.shape)
    if a.shape != shape and b.shape != shape:
        a = broadcast_to(a, shape)
    if a.shape != shape:
        y, x = joined(b, a, how)
        return x, y
    kept, _ = stretched(b, shape)
    left = a.frame("va")
    right = b.frame("vb").select(*[F.col(n).alias(m) for n, m in kept], "vb")
    if not kept:
        df = left.crossJoin(F.broadcast(right))  # one row: b has one element
    elif how == "outer" and b.shape == shape:
        df = left.join(right, [m for _, m in kept], "full")
    else:
        df = left.join(F.broadcast(right) if planner.small(b) and b.size < a.size else right, [m for _, m in kept])
    zero = lambda c, x: F.coalesce(F.col(c), F.lit(0).cast(SPARK_TYPES[x.dtype])) if how == "outer" else F.col(c)
    names = coords(len(shape))
    df = df.select(*names, zero("va", a).alias("va"), zero("vb", b).alias("vb"))
    return GridArray(df, shape, a.dtype, "va", a.sparse), GridArray(df, shape, b.dtype, "vb", b.sparse)


def _result(kind, *dtypes: str) -> str:
    if callable(kind):
        return kind(*dtypes)
    return kind or dtype_name(np.result_type(*dtypes))


def unary(x, fn, kind=None, zero_stays: bool = False) -> GridArray:
    """zero_stays: fn(0) is 0, so that a sparse array stays sparse."""
    x = as_array(x)
    x = x if zero_stays else x.dense()
    return GridArray(x.df, x.shape, _result(kind, x.dtype), fn(x.value.cast(SPARK_TYPES[x.dtype]), x), x.sparse)


def binary(a, b, fn, kind=None, sparse: str = "dense") -> GridArray:
    """sparse: 'outer' where fn(0, 0) is 0, 'inner' where fn(x, 0) and fn(0, x) are 0 too, else dense. fn takes two Columns and their result type."""
    for x, y, flip in ((a, b, False), (b, a, True)):
        if isinstance(x, GridArray) and not isinstance(y, GridArray) and np.ndim(y) == 0:
            dtype = _result(kind, x.dtype, dtype_name(np.asarray(y).dtype) if x.dtype == "bool" or isinstance(y, (bool, np.bool_)) or (isinstance(y, (float, np.floating)) and not x.floating) else x.dtype)
            x = x if sparse == "inner" else x.dense()
            own, other = x.value.cast(SPARK_TYPES[x.dtype]), F.lit(y.item() if isinstance(y, np.generic) else y)
            v = fn(other, own, dtype) if flip else fn(own, other, dtype)
            return GridArray(x.df, x.shape, dtype, v, x.sparse)
    a, b = as_array(a), as_array(b)
    dtype = _result(kind, a.dtype, b.dtype)
    if (a.sparse or b.sparse) and not (a.df is b.df):
        if sparse == "inner":
            x, y = joined(a, b)
            return GridArray(x.df, x.shape, dtype, fn(x.value, y.value, dtype), True)
        if sparse == "outer" and a.sparse and b.sparse and a.shape == b.shape:
            x, y = joined(a, b, "outer")
            return GridArray(x.df, x.shape, dtype, fn(x.value, y.value, dtype), True)
        a, b = a.dense(), b.dense()
    elif (a.sparse or b.sparse) and sparse == "dense":
        a = b = a.dense() if a is b else a
        if a.sparse:
            raise NotImplementedError("two expressions over one sparse relation")
    x, y = joined(a, b)
    return GridArray(x.df, x.shape, dtype, fn(x.value.cast(SPARK_TYPES[x.dtype]), y.value.cast(SPARK_TYPES[y.dtype]), dtype), x.sparse and y.sparse)


def _wide(fn):
    """Whole numbers are computed as 64 bits, others as doubles, and then cast to the result type."""

    def run(a: Column, b: Column, dtype: str) -> Column:
        kind = "double" if dtype.startswith("float") else "long"
        return fn(a.cast(kind), b.cast(kind)).cast(SPARK_TYPES[dtype])

    return run


def _number(*dtypes: str) -> str:
    name = dtype_name(np.result_type(*dtypes))
    return "int64" if name in ("bool", "int32", "int64") else name


def _real(*dtypes: str) -> str:
    name = dtype_name(np.result_type(*dtypes))
    return name if name.startswith("float") else "float64"


def add(a, b):
    return binary(a, b, _wide(lambda x, y: x + y), _number, "outer")


def sub(a, b):
    return binary(a, b, _wide(lambda x, y: x - y), _number, "outer")


def multiply(a, b):
    return binary(a, b, _wide(lambda x, y: x * y), _number, "inner")


def _divide(x, y, dtype):
    return numeric.true_div(x, y) if dtype.startswith("float") else numeric.floor_div(x, y, True)


def divide(a, b):
    """Of whole numbers the floor, as NumPy had it when arrays of this kind were new; else the quotient."""
    return binary(a, b, _divide, _number)


def true_divide(a, b):
    return binary(a, b, lambda x, y, d: numeric.true_div(x, y), _real)


def floor_divide(a, b):
    return binary(a, b, lambda x, y, d: numeric.floor_div(x, y, not d.startswith("float")), _number)


def mod(a, b):
    return binary(a, b, lambda x, y, d: numeric.mod(x, y, not d.startswith("float")), _number)


remainder = mod


def fmod(a, b):
    return binary(a, b, lambda x, y, d: numeric.fmod(x, y, not d.startswith("float")), _number)


def power(a, b):
    return binary(a, b, lambda x, y, d: numeric.power(x, y), _number)


def maximum(a, b):
    return binary(a, b, lambda x, y, d: numeric.maximum(x.cast(SPARK_TYPES[d]), y.cast(SPARK_TYPES[d]), d.startswith("float")), None, "outer")


def minimum(a, b):
    return binary(a, b, lambda x, y, d: numeric.minimum(x.cast(SPARK_TYPES[d]), y.cast(SPARK_TYPES[d]), d.startswith("float")), None, "outer")


def reciprocal(x):
    return unary(x, lambda v, a: numeric.true_div(F.lit(1.0), v) if a.floating else numeric.floor_div(F.lit(1), F.abs(v), True) * F.signum(v).cast("long"), lambda d: d if d.startswith("float") else "int64")


def negative(x):
    return unary(x, lambda v, a: -v, None, True)


def ln(x):
    return unary(x, lambda v, a: numeric.log(v), _real)


log = ln


def exp(x):
    return unary(x, lambda v, a: F.exp(v.cast("double")), _real)


def square(x):
    return unary(x, lambda v, a: v * v, None, True)


def sqrt(x):
    return unary(x, lambda v, a: F.sqrt(v.cast("double")), _real, True)


def abs(x):  # noqa: A001
    return unary(x, lambda v, a: F.abs(v), None, True)


def norm_cdf(x):
    return unary(x, lambda v, a: numeric.norm_cdf(v), "float64")


def astype(x, dtype):
    """Whole numbers come by cutting off, booleans by being other than zero."""
    to = dtype_name(dtype)
    return unary(x, lambda v, a: (v != 0) if to == "bool" else v.cast(SPARK_TYPES[to]), to, True)


def tocoo(x):
    """The relation already holds coordinates: a dense array becomes sparse by leaving out its zeros."""
    x = as_array(x)
    return x if x.sparse else GridArray(x.frame().where(F.col("v") != F.lit(0).cast(SPARK_TYPES[x.dtype])), x.shape, x.dtype, "v", True)


def size(x, axis=None) -> int:
    x = as_array(x)
    return x.size if axis is None else x.shape[axis]


def _compared(fn):
    """NaN is equal to nothing and not less or greater than anything; only != holds."""

    def run(x: Column, y: Column, dtype: str) -> Column:
        return fn(x, y)

    return run


def _nan(x: Column) -> Column:
    return F.isnan(x.cast("double"))


def equal(a, b):
    return binary(a, b, lambda x, y, d: (x == y) & ~_nan(x), "bool")


def not_equal(a, b):
    return binary(a, b, lambda x, y, d: (x != y) | _nan(x), "bool")


def greater(a, b):
    return binary(a, b, lambda x, y, d: (x > y) & ~_nan(x), "bool")


def greater_equal(a, b):
    return binary(a, b, lambda x, y, d: (x >= y) & ~_nan(x), "bool")


def less(a, b):
    return binary(a, b, lambda x, y, d: (x < y) & ~_nan(y), "bool")


def less_equal(a, b):
    return binary(a, b, lambda x, y, d: (x <= y) & ~_nan(y), "bool")


def truth(x: Column) -> Column:
    return x.cast("double") != 0.0


def logical_and(a, b):
    return binary(a, b, lambda x, y, d: truth(x) & truth(y), "bool", "inner")


def logical_or(a, b):
    return binary(a, b, lambda x, y, d: truth(x) | truth(y), "bool", "outer")


def logical_xor(a, b):
    return binary(a, b, lambda x, y, d: truth(x) != truth(y), "bool", "outer")


def logical_not(x):
    return unary(x, lambda v, a: ~truth(v), "bool")


def where(condition, a, b):
    """a where the condition holds, else b."""
    c = as_array(condition)
    picked = binary(c, a, lambda x, y, d: F.when(truth(x), y), lambda p, q: q)
    return binary(picked, b, lambda x, y, d: F.coalesce(x, y.cast(SPARK_TYPES[d])))
