"""NumPy's arithmetic as Column expressions: nothing raises, and NaN and infinities come out where NumPy has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def true_div(a: Column, b: Column) -> Column:
    """a / b as doubles; a zero divisor gives NaN or an infinity of the sign of a and of the zero."""
    a, b = a.cast("double"), b.cast("double")
    # -0.0 = 0.0 in Spark; its text tells them apart
    signed = F.when(F.startswith(b.cast("string"), F.lit("-")), -a).otherwise(a)
    return F.when(b != 0, F.try_divide(a, b)).when(a.isNull() | b.isNull(), None).when(F.isnan(a) | (a == 0), NAN).when(signed > 0, INF).otherwise(-INF)


def floor_div(a: Column, b: Column, whole: bool) -> Column:
    """The floor of a / b; of whole numbers exactly, with 0 for a zero divisor."""
    if whole:
        a, b = a.cast("long"), b.cast("long")
        q, r = F.call_function("try_divide", a - F.try_mod(a, b), b).cast("long"), F.try_mod(a, b)
        return F.when(b == 0, F.lit(0).cast("long")).otherwise(q - F.when((r != 0) & ((r < 0) != (b < 0)), 1).otherwise(0))
    q = true_div(a, b)
    return F.when(F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(q).cast("double"))


def mod(a: Column, b: Column, whole: bool) -> Column:
    """The remainder with the sign of b."""
    kind = "long" if whole else "double"
    a, b = a.cast(kind), b.cast(kind)
    r = F.try_mod(a, b)
    fixed = F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)
    return F.when(b == 0, F.lit(0 if whole else NAN).cast(kind)).otherwise(fixed)


def fmod(a: Column, b: Column, whole: bool) -> Column:
    """The remainder with the sign of a."""
    kind = "long" if whole else "double"
    return F.when(b == 0, F.lit(0 if whole else NAN).cast(kind)).otherwise(F.try_mod(a.cast(kind), b.cast(kind)))


def log(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x > 0, F.ln(x)).when(x == 0, -INF).when(x < 0, NAN).otherwise(x)


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def maximum(a: Column, b: Column, floating: bool) -> Column:
    """NaN if either is; Spark's order has NaN above all numbers."""
    return F.greatest(a, b)


def minimum(a: Column, b: Column, floating: bool) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(F.least(a, b)) if floating else F.least(a, b)


#: The five-term polynomial of the normal distribution (Abramowitz and Stegun, 26.2.17).
CDF_SCALE = 0.2316419
CDF_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CDF_NORM = 0.3989422804014327


def norm_cdf(x: Column) -> Column:
    """The standard normal distribution function."""
    z = F.abs(x.cast("double"))
    k = 1.0 / (1.0 + CDF_SCALE * z)
    series = F.lit(0.0)
    for term in reversed(CDF_TERMS):
        series = (series + term) * k
    tail = CDF_NORM * F.exp(-z * z / 2.0) * series
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)
