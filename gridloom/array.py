"""Lazy n-dimensional arrays over Spark DataFrames.

An array is a relation: one row for each stored element, its coordinates in the
columns i0, i1, ... and its value as an expression over the row's columns. Maps
over arrays of one relation only compose expressions, so that Catalyst fuses
them into one projection; arrays of different relations meet in a join on their
coordinates. A sparse array stores the elements that differ from zero and
counts the others as zero; a dense one stores all of them. Shape, element type
and sparsity are metadata on the driver.
"""

from __future__ import annotations

import builtins
from math import prod as product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_TYPES = {"float64": "double", "float32": "float", "int64": "long", "int32": "int", "bool": "boolean"}
newaxis = None


class NotShapeable(Exception):
    """The shape depends on data that has not been looked at."""


def dtype_name(dtype) -> str:
    name = np.dtype(dtype).name
    if name not in SPARK_TYPES:
        name = {"b": "bool", "i": "int64", "u": "int64", "f": "float64"}[np.dtype(dtype).kind]
    return name


def coords(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def ravelled(names: list[str], shape: tuple[int, ...]) -> Column:
    """The position of an element in C order."""
    at = F.lit(0).cast("long")
    for name, size in zip(names, shape, strict=True):
        at = at * F.lit(size).cast("long") + F.col(name)
    return at


def unravelled(position: Column, shape: tuple[int, ...]) -> list[Column]:
    """The coordinates at a C-order position, named i0, i1, ..."""
    out, stride = [], 1
    for k in range(len(shape) - 1, -1, -1):
        x = F.call_function("div", position, F.lit(stride).cast("long")) if stride > 1 else position
        out.append((x % F.lit(shape[k]).cast("long") if k else x).cast("long").alias(f"i{k}"))
        stride *= max(shape[k], 1)
    return out[::-1]


class GridArray:
    """df: the relation, with the coordinate columns i0..; value: an expression over its columns."""

    __array_priority__ = 1000

    def __init__(self, df: DataFrame, shape: tuple[int, ...], dtype="float64", value: Column | str = "v", sparse: bool = False):
        self.df, self.shape, self.dtype, self.sparse = df, tuple(int(s) for s in shape), dtype_name(dtype), sparse
        self.value = F.col(value) if isinstance(value, str) else value

    # metadata

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return product(self.shape)

    @property
    def coords(self) -> list[str]:
        return coords(self.ndim)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def floating(self) -> bool:
        return self.dtype.startswith("float")

    def __repr__(self) -> str:
        return f"GridArray(shape={self.shape}, dtype={self.dtype}{', sparse' if self.sparse else ''})"

    def __len__(self) -> int:
        return self.shape[0]

    # evaluation

    def frame(self, value: str = "v") -> DataFrame:
        """(i0, ..., value): what the array stores."""
        kind = SPARK_TYPES[self.dtype]
        return self.df.select(*[F.col(c).cast("long").alias(c) for c in self.coords], self.value.cast(kind).alias(value))

    def settled(self) -> GridArray:
        """The same array with its value as a column: what follows starts from there."""
        return GridArray(self.frame(), self.shape, self.dtype, "v", self.sparse)

    def evaluate(self) -> GridArray:
        """Compute now, and keep the result in executors' memory or on their disks."""
        out = GridArray(self.frame().persist(), self.shape, self.dtype, "v", self.sparse)
        out.df.count()
        return out

    force = evaluate

    def optimized(self) -> GridArray:
        """The same: Catalyst optimizes every plan when it runs."""
        return self

    def glom(self):
        """All elements as one NumPy array on the driver; for results that fit there."""
        table = self.frame().toArrow()
        out = np.zeros(self.shape, self.dtype)
        values = table.column("v").to_numpy()
        if self.ndim:
            out[tuple(table.column(c).to_numpy() for c in self.coords)] = values
        elif len(values):
            out[()] = values[0]
        return out

    def dense(self) -> GridArray:
        """With a stored row for every element."""
        if not self.sparse:
            return self
        grid = grid_frame(self.spark, self.shape)
        kind = SPARK_TYPES[self.dtype]
        df = grid.join(self.frame(), self.coords, "left").select(*self.coords, F.coalesce("v", F.lit(0).cast(kind)).alias("v"))
        return GridArray(df, self.shape, self.dtype)

    # operators

    def __add__(self, o):
        return _m().add(self, o)

    def __radd__(self, o):
        return _m().add(o, self)

    def __sub__(self, o):
        return _m().sub(self, o)

    def __rsub__(self, o):
        return _m().sub(o, self)

    def __mul__(self, o):
        return _m().multiply(self, o)

    def __rmul__(self, o):
        return _m().multiply(o, self)

    def __truediv__(self, o):
        return _m().divide(self, o)

    def __rtruediv__(self, o):
        return _m().divide(o, self)

    def __floordiv__(self, o):
        return _m().floor_divide(self, o)

    def __rfloordiv__(self, o):
        return _m().floor_divide(o, self)

    def __mod__(self, o):
        return _m().mod(self, o)

    def __rmod__(self, o):
        return _m().mod(o, self)

    def __pow__(self, o):
        return _m().power(self, o)

    def __rpow__(self, o):
        return _m().power(o, self)

    def __neg__(self):
        return _m().negative(self)

    def __abs__(self):
        return _m().abs(self)

    def __eq__(self, o):
        return _m().equal(self, o)

    def __ne__(self, o):
        return _m().not_equal(self, o)

    def __lt__(self, o):
        return _m().less(self, o)

    def __le__(self, o):
        return _m().less_equal(self, o)

    def __gt__(self, o):
        return _m().greater(self, o)

    def __ge__(self, o):
        return _m().greater_equal(self, o)

    def __and__(self, o):
        return _m().logical_and(self, o)

    def __or__(self, o):
        return _m().logical_or(self, o)

    def __xor__(self, o):
        return _m().logical_xor(self, o)

    def __invert__(self):
        return _m().logical_not(self)

    __hash__ = None

    def __bool__(self):
        if self.size != 1:
            raise ValueError("the truth of an array of more than one element is ambiguous")
        return bool(self.glom().ravel()[0])

    def __matmul__(self, o):
        from .operators.linalg import dot

        return dot(self, o)

    dot = __matmul__

    def __getitem__(self, index):
        from .operators.indexing import getitem

        return getitem(self, index)

    def __setitem__(self, index, value):
        raise TypeError("arrays are read-only; use assign()")

    def reshape(self, *shape):
        from .operators.indexing import reshape

        return reshape(self, *shape)

    def ravel(self):
        return self.reshape(self.size)

    flatten = ravel

    @property
    def T(self):  # noqa: N802
        from .operators.indexing import transpose

        return transpose(self)

    def transpose(self):
        return self.T

    def astype(self, dtype):
        return _m().astype(self, dtype)

    def fill(self, value):
        from .operators.creation import full_like

        return full_like(self, value)

    def diagonal(self):
        from .operators.creation import diagonal

        return diagonal(self)

    def __getattr__(self, name):
        """sum, prod, max, min, mean, std, all, any, argmin, argmax, count_nonzero, count_zero by method."""
        from .operators import reduction

        if name in reduction.METHODS:
            return lambda *a, **k: getattr(reduction, name)(self, *a, **k)
        raise AttributeError(name)


def _m():
    from .operators import elementwise

    return elementwise


def grid_frame(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All coordinates of a shape, by arithmetic on a distributed range: no shuffle, no join."""
    return spark.range(product(shape)).select(*unravelled(F.col("id"), shape)) if shape else spark.range(1).select()


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("there is no Spark session")
    return found


def from_table(df: DataFrame, keys: list[str], value: str | Column, shape: tuple[int, ...] | None = None, dtype=None, sparse: bool = False, combine=F.sum) -> GridArray:
    """An array from a table with a row for each element. The shape, if not given, is one above the largest keys. For sparse arrays rows of equal keys are combined."""
    names = coords(len(keys))
    v = F.col(value) if isinstance(value, str) else value
    own = df.select(*[F.col(k).cast("long").alias(n) for k, n in zip(keys, names, strict=True)], v.alias("v"))
    if sparse:
        own = own.groupBy(*names).agg(combine("v").alias("v"))
    if shape is None:
        top = df.agg(*[(F.max(k) + 1).cast("long") for k in keys]).first()
        shape = tuple(x or 0 for x in top)
    if dtype is None:
        dtype = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "boolean": "bool"}.get(dict(own.dtypes)["v"], "float64")
    return GridArray(own, shape, dtype, "v", sparse)


def from_vectors(df: DataFrame, key: str, vector: str, shape: tuple[int, int] | None = None) -> GridArray:
    """A matrix from a table with an array column: a row for each key."""
    if shape is None:
        top = df.agg((F.max(key) + 1).cast("long"), F.max(F.size(vector))).first()
        shape = (top[0] or 0, builtins.max(top[1] or 0, 0))
    return GridArray(df.select(F.col(key).cast("long").alias("i0"), F.posexplode(vector).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), shape)


def as_array(x, spark: SparkSession | None = None) -> GridArray:
    """A GridArray from whatever: an array itself, a NumPy array, a list or a scalar."""
    if isinstance(x, GridArray):
        return x
    from .sources.arrays import from_numpy

    return from_numpy(np.asarray(x), spark)


lazify = as_array


def eager(x: GridArray) -> GridArray:
    return as_array(x).evaluate()


def evaluate(x: GridArray) -> GridArray:
    return as_array(x).evaluate()


def glom(x):
    return x.glom() if isinstance(x, GridArray) else np.asarray(x)


def optimized_dag(x: GridArray) -> GridArray:
    return x.optimized()
