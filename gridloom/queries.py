"""The registered queries of the array operators, each over whole tables, with the SQL that gives the same rows.

Arrays of the tables: O order totals and K their customers by order number, P
part prices by part number, V event values by event number, E the embeddings
(vectors by component), U the number of events by user and kind, L the quantity
by order and part (sparse; repeated coordinates add up).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .algorithms import clustering, decomposition, learning, simulation
from .array import GridArray, from_table, from_vectors
from .functions import numeric
from .operators import creation, elementwise, image, indexing, kernels, linalg, reduction, sorting
from .session import kept, shared_dir, ship
from .sources import arrays
from .streaming import reductions as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def _o(spark, d):
    return from_table(table(spark, d, "orders"), ["o_orderkey"], "o_totalprice")


def _k(spark, d):
    return from_table(table(spark, d, "orders"), ["o_orderkey"], "o_custkey")


def _p(spark, d):
    return from_table(table(spark, d, "part"), ["p_partkey"], "p_retailprice")


def _v(spark, d):
    return from_table(table(spark, d, "events"), ["event_id"], "value")


def _e(spark, d):
    return from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def _rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _kind(c: str) -> Column:
    return F.pmod(F.length(c), F.lit(5))


def _u(spark, d):
    events = table(spark, d, "events").select("user_id", _kind("event_type").alias("kind"))
    return from_table(events, ["user_id", "kind"], F.lit(1), sparse=True, dtype="int64")


def _l(spark, d):
    return from_table(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], "l_quantity", sparse=True)


#: The arrays as common table expressions for the oracles.
E = "E AS (SELECT vec_id::BIGINT AS i0, (unnest(generate_series(0, len(embedding) - 1)))::BIGINT AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings)"
O = "O AS (SELECT o_orderkey::BIGINT AS i0, o_totalprice AS v FROM orders)"  # noqa: E741
K = "K AS (SELECT o_orderkey::BIGINT AS i0, o_custkey::BIGINT AS v FROM orders)"
P = "P AS (SELECT p_partkey::BIGINT AS i0, p_retailprice AS v FROM part)"
V = "V AS (SELECT event_id::BIGINT AS i0, value AS v FROM events)"
U = "U AS (SELECT user_id::BIGINT AS i0, (length(event_type) % 5)::BIGINT AS i1, count(*)::BIGINT AS v FROM events GROUP BY ALL)"
L = "L AS (SELECT l_orderkey::BIGINT AS i0, l_partkey::BIGINT AS i1, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
US = "US AS (SELECT (SELECT max(user_id) + 1 FROM events) AS n, (SELECT max(length(event_type) % 5) + 1 FROM events) AS m)"
UD = f"{U}, {US}, UD AS (SELECT a.i AS i0, b.i AS i1, coalesce(U.v, 0)::BIGINT AS v FROM (SELECT unnest(generate_series(0, n - 1))::BIGINT AS i FROM US) a CROSS JOIN (SELECT unnest(generate_series(0, m - 1))::BIGINT AS i FROM US) b LEFT JOIN U ON U.i0 = a.i AND U.i1 = b.i)"


def add(name: str, fn: Callable[[SparkSession, str], DataFrame | GridArray], sql: str | None = None, digits: int | None = None) -> None:
    """digits: to which floating results are rounded, here and in the SQL's v."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = fn(spark, d)
        if isinstance(out, GridArray):
            out = out.frame()
        return out.withColumn("v", F.round("v", digits)) if digits is not None else out

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# elementwise

_D = "SELECT i0, {x} AS v FROM {t}"
for name, fn, sql, array, cte in [
    ("add", lambda x: x + x * 2.0, "v + v * 2", _o, O),
    ("sub", lambda x: 100.0 - x, "100 - v", _o, O),
    ("multiply", lambda x: x * 3.0, "v * 3", _o, O),
    ("true_divide", lambda x: elementwise.true_divide(x, 7.0), "v / 7", _o, O),
    ("floor_divide", lambda x: elementwise.floor_divide(x, 7.0), "floor(v / 7)", _o, O),
    ("reciprocal", elementwise.reciprocal, "1 / v", _o, O),
    ("negative", elementwise.negative, "-v", _o, O),
    ("power", lambda x: elementwise.power(x, 0.5), "pow(v, 0.5)", _o, O),
    ("maximum", lambda x: elementwise.maximum(x, 1000.0), "greatest(v, 1000)", _o, O),
    ("minimum", lambda x: elementwise.minimum(x, 1000.0), "least(v, 1000)", _o, O),
    ("log", elementwise.log, "ln(v)", _o, O),
    ("ln", elementwise.ln, "ln(v)", _o, O),
    ("exp", lambda x: elementwise.exp(x / 1e6), "exp(v / 1e6)", _o, O),
    ("square", elementwise.square, "v * v", _v, V),
    ("sqrt", elementwise.sqrt, "sqrt(v)", _o, O),
    ("abs", lambda x: abs(x - 50.0), "abs(v - 50)", _v, V),
    ("norm_cdf", lambda x: elementwise.norm_cdf((x - 50.0) / 20.0), None, _v, V),
]:
    if name == "norm_cdf":
        z = "abs((v - 50) / 20)"
        k = f"(1 / (1 + {numeric.CDF_SCALE} * {z}))"
        series = "0"
        for term in reversed(numeric.CDF_TERMS):
            series = f"(({series} + ({term})) * {k})"
        tail = f"({numeric.CDF_NORM} * exp(-{z} * {z} / 2) * {series})"
        sql = f"CASE WHEN v >= 50 THEN 1 - {tail} ELSE {tail} END"
    add(f"map_{name}", lambda s, d, f=fn, a=array: f(a(s, d)), f"WITH {cte} SELECT i0, round({sql}, 6) AS v FROM {cte.split()[0]}", 6)

for name, fn, sql in [
    ("divide_int", lambda x: elementwise.divide(x - 50, 7), "floor((v - 50) / 7.0)::BIGINT"),
    ("mod", lambda x: (x - 50) % 7, "(v - 50) - floor((v - 50) / 7.0)::BIGINT * 7"),
    ("remainder", lambda x: elementwise.remainder(x - 50, -7), "(v - 50) - floor((v - 50) / -7.0)::BIGINT * -7"),
    ("fmod", lambda x: elementwise.fmod(x - 50, 7), "(v - 50) % 7"),
    ("equal", lambda x: x == 7, "v = 7"),
    ("not_equal", lambda x: x != 7, "v <> 7"),
    ("greater", lambda x: x > 70, "v > 70"),
    ("greater_equal", lambda x: x >= 70, "v >= 70"),
    ("less", lambda x: x < 70, "v < 70"),
    ("less_equal", lambda x: x <= 70, "v <= 70"),
    ("logical_and", lambda x: (x % 2) & (x > 9), "v % 2 <> 0 AND v > 9"),
    ("logical_or", lambda x: (x % 2) | (x > 9), "v % 2 <> 0 OR v > 9"),
    ("logical_xor", lambda x: (x % 2) ^ (x > 9), "(v % 2 <> 0) <> (v > 9)"),
    ("logical_not", lambda x: ~(x % 3), "v % 3 = 0"),
]:
    add(f"map_{name}", lambda s, d, f=fn: f(_k(s, d)), f"WITH {K} SELECT i0, {sql} AS v FROM K")

add("map_astype", lambda s, d: _o(s, d).astype("int64"), f"WITH {O} SELECT i0, trunc(v)::BIGINT AS v FROM O")
add("map_divide_zero", lambda s, d: elementwise.true_divide(_k(s, d) - 9, _k(s, d) % 3), f"WITH {K} SELECT i0, (v - 9)::DOUBLE / (v % 3)::DOUBLE AS v FROM K WHERE v % 3 <> 0 UNION ALL SELECT i0, CASE WHEN v = 9 THEN 'nan'::DOUBLE WHEN v > 9 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END FROM K WHERE v % 3 = 0")
add("map_two_arrays", lambda s, d: _o(s, d) * _k(s, d), f"WITH {O}, {K} SELECT i0, round(O.v * K.v, 3) AS v FROM O JOIN K USING (i0)", 3)
add("map_where", lambda s, d: elementwise.where(_k(s, d) > 50, _o(s, d), 0.0), f"WITH {O}, {K} SELECT i0, CASE WHEN K.v > 50 THEN O.v ELSE 0 END AS v FROM O JOIN K USING (i0)")
add("map_udf_vectorized", lambda s, d: kernels.map(_o(s, d), np.log1p, vectorized=True), f"WITH {O} SELECT i0, round(ln(v + 1), 9) AS v FROM O", 9)
add("map_with_location", lambda s, d: kernels.map_with_location(_e(s, d), lambda v, i, j: v + i * 1000.0 + j), f"WITH {E} SELECT i0, i1, round(v + i0 * 1000 + i1, 6) AS v FROM E", 6)
add("broadcast_row", lambda s, d: _e(s, d) - _e(s, d).mean(0), f"WITH {E}, m AS (SELECT i1, avg(v) AS a FROM E GROUP BY i1) SELECT i0, i1, round(v - a, 6) AS v FROM E JOIN m USING (i1)", 6)
add("broadcast_column", lambda s, d: _e(s, d) * _k(s, d)[: _e(s, d).shape[0]].reshape(-1, 1), f"WITH {E}, {K} SELECT E.i0, i1, round(E.v * K.v, 5) AS v FROM E JOIN K ON E.i0 = K.i0", 5)
add("tocoo", lambda s, d: elementwise.tocoo(_k(s, d) % 3), f"WITH {K} SELECT i0, v % 3 AS v FROM K WHERE v % 3 <> 0")
add("sparse_add", lambda s, d: _u(s, d) + _u(s, d).T.T, f"WITH {U} SELECT i0, i1, 2 * v AS v FROM U")
add("sparse_multiply_dense", lambda s, d: _u(s, d) * _u(s, d).dense(), f"WITH {U} SELECT i0, i1, v * v AS v FROM U")
add("sparse_densify_exp", lambda s, d: elementwise.exp(_u(s, d) / 10.0), f"WITH {UD} SELECT i0, i1, round(exp(v / 10.0), 6) AS v FROM UD", 6)

# reductions

for name, agg, digits in [("sum", "sum(v)", 4), ("max", "max(v)", None), ("min", "min(v)", None), ("mean", "avg(v)", 6), ("std", "stddev_pop(v)", 6)]:
    for axis, key, group in ((None, "", ""), (0, "i1 AS i0, ", " GROUP BY i1"), (1, "i0, ", " GROUP BY i0")):
        v = f"round({agg}, {digits})" if digits else agg
        add(f"reduce_{name}_{'all' if axis is None else f'axis{axis}'}", lambda s, d, n=name, x=axis: getattr(reduction, n)(_e(s, d), x), f"WITH {E} SELECT {key}{v} AS v FROM E{group}", digits)
for name, agg in [("sum", "sum(v)::BIGINT"), ("count_nonzero", "count(*) FILTER (v <> 0)"), ("count_zero", "count(*) FILTER (v = 0)"), ("all", "bool_and(v <> 0)"), ("any", "bool_or(v <> 0)"), ("max", "max(v)"), ("min", "min(v)")]:
    for axis, key, group in ((None, "", ""), (0, "i1 AS i0, ", " GROUP BY i1"), (1, "i0, ", " GROUP BY i0")):
        add(f"reduce_sparse_{name}_{'all' if axis is None else f'axis{axis}'}", lambda s, d, n=name, x=axis: getattr(reduction, n)(_u(s, d), x), f"WITH {UD} SELECT {key}{agg} AS v FROM UD{group}")
add("reduce_prod_axis1", lambda s, d: reduction.prod(_e(s, d) + 1.0, 1), f"WITH {E} SELECT i0, round(product(v + 1), 6) AS v FROM E GROUP BY i0", 6)
for name, order in (("argmax", "v DESC"), ("argmin", "v")):
    add(f"{name}_axis0", lambda s, d, n=name: getattr(reduction, n)(_e(s, d), 0), f"WITH {E} SELECT i1 AS i0, i0 AS v FROM E QUALIFY row_number() OVER (PARTITION BY i1 ORDER BY {order}, i0) = 1")
    add(f"{name}_axis1", lambda s, d, n=name: getattr(reduction, n)(_e(s, d), 1), f"WITH {E} SELECT i0, i1 AS v FROM E QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY {order}, i1) = 1")
    add(f"{name}_all", lambda s, d, n=name: getattr(reduction, n)(_e(s, d)), f"WITH {E} SELECT i0 * 64 + i1 AS v FROM E ORDER BY E.{order}, i0, i1 LIMIT 1")
add("bincount", lambda s, d: reduction.bincount(from_table(table(s, d, "part"), ["p_partkey"], "p_size")), "SELECT x AS i0, count(p_size)::BIGINT AS v FROM (SELECT unnest(generate_series(0, (SELECT max(p_size) FROM part)))::BIGINT AS x) LEFT JOIN part ON p_size = x GROUP BY x")
add("bincount_weighted", lambda s, d: reduction.bincount(from_table(table(s, d, "events"), ["event_id"], "user_id"), _v(s, d)), "SELECT x AS i0, round(coalesce(sum(value), 0), 4) AS v FROM (SELECT unnest(generate_series(0, (SELECT max(user_id) FROM events)))::BIGINT AS x) LEFT JOIN events ON user_id = x GROUP BY x", 4)
add("normalize_all", lambda s, d: reduction.normalize(_o(s, d)), f"WITH {O} SELECT i0, round(v / sum(v) OVER (), 10) AS v FROM O", 10)
add("normalize_axis0", lambda s, d: reduction.normalize(_u(s, d), 0), f"WITH {U} SELECT i0, i1, round(v / sum(v) OVER (PARTITION BY i1), 8) AS v FROM U", 8)
add("normalize_axis1", lambda s, d: reduction.normalize(_u(s, d), 1), f"WITH {U} SELECT i0, i1, round(v / sum(v) OVER (PARTITION BY i0), 8) AS v FROM U", 8)
_one = lambda s, x: s.createDataFrame([(float(x),)], "v double")
add("norm_l1", lambda s, d: _one(s, reduction.norm(_e(s, d), 1)), f"WITH {E} SELECT round(max(x), 4) AS v FROM (SELECT sum(abs(v)) AS x FROM E GROUP BY i1)", 4)
add("norm_l2", lambda s, d: _one(s, reduction.norm(_o(s, d))), f"WITH {O} SELECT round(sqrt(sum(v * v)), 3) AS v FROM O", 3)
add("reduce_custom", lambda s, d: reduction.reduce(_e(s, d), 1, "float64", lambda x: float((x * x).sum()), lambda a, b: a + b), f"WITH {E} SELECT i0, round(sum(v * v), 6) AS v FROM E GROUP BY i0", 6)
add("size", lambda s, d: s.createDataFrame([(int(elementwise.size(_e(s, d))),)], "v long"), f"WITH {E} SELECT count(*) AS v FROM E")

# indexing and shape

add("slice_box", lambda s, d: _e(s, d)[10:200, 3:40], f"WITH {E} SELECT i0 - 10 AS i0, i1 - 3 AS i1, v FROM E WHERE i0 BETWEEN 10 AND 199 AND i1 BETWEEN 3 AND 39")
add("slice_int", lambda s, d: _e(s, d)[7], f"WITH {E} SELECT i1 AS i0, v FROM E WHERE i0 = 7")
add("slice_ints", lambda s, d: _e(s, d)[7, -1], f"WITH {E} SELECT v FROM E WHERE i0 = 7 AND i1 = 63")
add("slice_step", lambda s, d: _e(s, d)[1::3, ::-2], f"WITH {E} SELECT (i0 - 1) // 3 AS i0, (63 - i1) // 2 AS i1, v FROM E WHERE (i0 - 1) % 3 = 0 AND i0 >= 1 AND (63 - i1) % 2 = 0")
add("newaxis", lambda s, d: _p(s, d)[:, None], f"WITH {P} SELECT i0, 0::BIGINT AS i1, v FROM P")
add("mask_filter", lambda s, d: _o(s, d)[_o(s, d) > 1000.0], f"WITH {O} SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM O WHERE v > 1000")
add("masked", lambda s, d: indexing.masked(_o(s, d), _o(s, d) > 1000.0), f"WITH {O} SELECT i0, v FROM O WHERE v > 1000")
add("take", lambda s, d: _p(s, d)[from_table(table(s, d, "part"), ["p_partkey"], "p_size")], f"WITH {P} SELECT p_partkey::BIGINT AS i0, P.v FROM part JOIN P ON P.i0 = p_size")
add("reshape", lambda s, d: _e(s, d).reshape(-1, 32), f"WITH {E} SELECT (i0 * 64 + i1) // 32 AS i0, (i0 * 64 + i1) % 32 AS i1, v FROM E")
add("ravel", lambda s, d: _e(s, d).ravel(), f"WITH {E} SELECT i0 * 64 + i1 AS i0, v FROM E")
add("transpose", lambda s, d: _e(s, d).T, f"WITH {E} SELECT i1 AS i0, i0 AS i1, v FROM E")
add("concatenate_axis0", lambda s, d: indexing.concatenate(_o(s, d), _p(s, d)), f"WITH {O}, {P} SELECT i0, v FROM O UNION ALL SELECT i0 + (SELECT max(i0) + 1 FROM O), v FROM P")
add("concatenate_axis1", lambda s, d: indexing.concatenate(_e(s, d), _e(s, d) * 2.0, 1), f"WITH {E} SELECT i0, i1, v FROM E UNION ALL SELECT i0, i1 + 64, v * 2 FROM E")
add("assign_scalar", lambda s, d: indexing.assign(_e(s, d), (slice(5, 50), slice(0, 8)), 9.0), f"WITH {E} SELECT i0, i1, CASE WHEN i0 BETWEEN 5 AND 49 AND i1 < 8 THEN 9.0 ELSE v END AS v FROM E")
add("assign_array", lambda s, d: indexing.assign(_e(s, d), 3, _e(s, d)[9]), f"WITH {E} SELECT a.i0, a.i1, CASE WHEN a.i0 = 3 THEN b.v ELSE a.v END AS v FROM E a JOIN E b ON b.i0 = 9 AND b.i1 = a.i1")
add("write_region", lambda s, d: indexing.write(_e(s, d), slice(0, 100), _e(s, d), slice(100, 200), lambda a, b: a + b), f"WITH {E} SELECT a.i0, a.i1, round(CASE WHEN a.i0 < 100 THEN a.v + b.v ELSE a.v END, 9) AS v FROM E a LEFT JOIN E b ON b.i0 = a.i0 + 100 AND b.i1 = a.i1", 9)
add("region_map", lambda s, d: indexing.region_map(_e(s, d), [(slice(0, 4),), (slice(None), slice(60, 64))], lambda v: v + 1.0), f"WITH {E} SELECT i0, i1, CASE WHEN i0 < 4 OR i1 >= 60 THEN v + 1 ELSE v END AS v FROM E")
add("retile", lambda s, d: indexing.retile(_e(s, d), (100, 16)), f"WITH {E} SELECT i0, i1, v FROM E")

# creation

add("arange", lambda s, d: creation.arange(2, 5000, 3, "int64"), "SELECT i::BIGINT AS i0, (2 + 3 * i)::BIGINT AS v FROM range(1666) t(i)")
add("arange_shape", lambda s, d: creation.arange((50, 40), dtype="int64"), "SELECT (i // 40)::BIGINT AS i0, (i % 40)::BIGINT AS i1, i::BIGINT AS v FROM range(2000) t(i)")
for name, value in (("zeros", 0), ("ones", 1), ("empty", 0)):
    add(name, lambda s, d, n=name: getattr(creation, n)((30, 20), "float64"), f"SELECT (i // 20)::BIGINT AS i0, (i % 20)::BIGINT AS i1, {value}::DOUBLE AS v FROM range(600) t(i)")
add("full", lambda s, d: creation.full((30, 20), 2.5, "float64"), "SELECT (i // 20)::BIGINT AS i0, (i % 20)::BIGINT AS i1, 2.5::DOUBLE AS v FROM range(600) t(i)")
for name, value in (("zeros_like", 0), ("ones_like", 1), ("empty_like", 0)):
    add(name, lambda s, d, n=name: getattr(creation, n)(_p(s, d)), f"WITH {P} SELECT i0, {value}::DOUBLE AS v FROM P")
add("full_like", lambda s, d: creation.full_like(_p(s, d), 7.0), f"WITH {P} SELECT i0, 7::DOUBLE AS v FROM P")
add("eye", lambda s, d: creation.eye(40, 60, 2, "float64"), "SELECT (i // 60)::BIGINT AS i0, (i % 60)::BIGINT AS i1, (CASE WHEN i % 60 = i // 60 + 2 THEN 1 ELSE 0 END)::DOUBLE AS v FROM range(2400) t(i)")
add("identity", lambda s, d: creation.identity(30, "float64"), "SELECT (i // 30)::BIGINT AS i0, (i % 30)::BIGINT AS i1, (CASE WHEN i % 30 = i // 30 THEN 1 ELSE 0 END)::DOUBLE AS v FROM range(900) t(i)")
add("sparse_diagonal", lambda s, d: creation.sparse_diagonal((500, 400), "float64"), "SELECT i::BIGINT AS i0, i::BIGINT AS i1, 1::DOUBLE AS v FROM range(400) t(i)")
add("sparse_empty", lambda s, d: creation.sparse_empty((5, 5), "float64"), "SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, 0::DOUBLE AS v WHERE false")
add("diagflat", lambda s, d: creation.diagflat(_p(s, d)[:50]), f"WITH {P} SELECT (i // 50)::BIGINT AS i0, (i % 50)::BIGINT AS i1, CASE WHEN i // 50 = i % 50 THEN v ELSE 0 END AS v FROM range(2500) t(i) JOIN P ON P.i0 = i // 50")
add("diagonal", lambda s, d: creation.diagonal(_e(s, d)), f"WITH {E} SELECT i0, v FROM E WHERE i0 = i1")
add("diag", lambda s, d: creation.diag(_e(s, d)), f"WITH {E} SELECT i0, v FROM E WHERE i0 = i1")
add("rand", lambda s, d: creation.rand(1000, seed=1))
add("randn", lambda s, d: creation.randn(100, 10, seed=1))
add("randint", lambda s, d: creation.randint(1000, low=3, high=9, seed=1))
add("sparse_rand", lambda s, d: creation.sparse_rand((1000, 1000), 0.001, seed=1))

# products

add("dot_matrix_matrix", lambda s, d: linalg.dot(_e(s, d).T, _e(s, d)), f"WITH {E} SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 5) AS v FROM E a JOIN E b USING (i0) GROUP BY a.i1, b.i1", 5)
add("dot_matrix_vector", lambda s, d: linalg.dot(_e(s, d), _p(s, d)[:64]), f"WITH {E}, {P} SELECT E.i0, round(sum(E.v * P.v), 4) AS v FROM E JOIN P ON P.i0 = E.i1 GROUP BY E.i0", 4)
add("dot_vector_matrix", lambda s, d: linalg.dot(_e(s, d)[:, 0], _e(s, d)), f"WITH {E} SELECT b.i1 AS i0, round(sum(a.v * b.v), 5) AS v FROM E a JOIN E b ON a.i0 = b.i0 AND a.i1 = 0 GROUP BY b.i1", 5)
add("dot_vector_vector", lambda s, d: linalg.dot(_o(s, d), _k(s, d)), f"WITH {O}, {K} SELECT 0::BIGINT AS i0, round(sum(O.v * K.v), 1) AS v FROM O JOIN K USING (i0)", 1)
add("dot_sparse_vector", lambda s, d: linalg.dot(_l(s, d), from_table(table(s, d, "part"), ["p_partkey"], "p_size", shape=(_l(s, d).shape[1],))), f"WITH {L} SELECT i0, round(sum(v * p_size), 3) AS v FROM L JOIN part ON p_partkey = i1 GROUP BY i0", 3)
add("dot_sparse_sparse", lambda s, d: linalg.dot(_u(s, d).T, _u(s, d)), f"WITH {U} SELECT a.i1 AS i0, b.i1, sum(a.v * b.v)::BIGINT AS v FROM U a JOIN U b USING (i0) GROUP BY a.i1, b.i1")
add("dot_local", lambda s, d: linalg.dot(_e(s, d), np.arange(64.0)), f"WITH {E} SELECT i0, round(sum(v * i1), 4) AS v FROM E GROUP BY i0", 4)
add("dot_block", lambda s, d: linalg._block_dot(_e(s, d).T, _e(s, d), "float64", 128), f"WITH {E} SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 5) AS v FROM E a JOIN E b USING (i0) GROUP BY a.i1, b.i1", 5)
add("outer_distances", lambda s, d: linalg.outer(_e(s, d), _e(s, d), lambda a, b: (a - b) * (a - b), vectorized=True), f"WITH {E} SELECT a.i0, b.i0 AS i1, round(sum((a.v - b.v) * (a.v - b.v)), 5) AS v FROM E a JOIN E b ON a.i1 = b.i1 GROUP BY a.i0, b.i0", 5)
add("map2_join", lambda s, d: kernels.map2([_e(s, d), _e(s, d)], (0, 0), lambda a, va, b, vb: ([a[1], b[1]], va * vb), (64, 64)), f"WITH {E} SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 5) AS v FROM E a JOIN E b USING (i0) GROUP BY a.i1, b.i1", 5)
add("shuffle_scatter", lambda s, d: kernels.shuffle(_o(s, d), lambda i, v: ([i % 100], v), (100,)), f"WITH {O} SELECT i0 % 100 AS i0, round(sum(v), 3) AS v FROM O GROUP BY i0 % 100", 3)
add("shuffle_by_label", lambda s, d: _label_sums(s, d), "SELECT label::BIGINT AS i0, x::BIGINT AS i1, round(sum(embedding[x + 1]::DOUBLE), 5) AS v FROM embeddings, range(64) t(x) GROUP BY ALL", 5)
add("tile_operation", lambda s, d: kernels.tile_operation(_e(s, d), (128, 16), lambda t, f: t.sum()).withColumnRenamed("value", "v"), f"WITH {E} SELECT i0 // 128 AS t0, i1 // 16 AS t1, round(sum(v), 5) AS v FROM E GROUP BY ALL", 5)
add("map_tiles", lambda s, d: kernels.map_tiles(_e(s, d), (128, 64), lambda t, f: t - t.mean(1, keepdims=True)), f"WITH {E} SELECT i0, i1, round(v - avg(v) OVER (PARTITION BY i0), 6) AS v FROM E", 6)


def _label_sums(s, d):
    vectors = table(s, d, "embeddings")
    labels = from_table(vectors, ["vec_id"], "label")
    return kernels.map2([labels, _e(s, d)], (0, 0), lambda a, label, b, v: ([label, b[1]], v), (10, 64))


# order

add("sort_axis1", lambda s, d: sorting.sort(_e(s, d), 1), f"WITH {E} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v) - 1 AS i1, v FROM E")
add("sort_axis0", lambda s, d: sorting.sort(_e(s, d), 0), f"WITH {E} SELECT row_number() OVER (PARTITION BY i1 ORDER BY v) - 1 AS i0, i1, v FROM E")
add("sort_flat", lambda s, d: sorting.sort(_o(s, d), None), f"WITH {O} SELECT row_number() OVER (ORDER BY v) - 1 AS i0, v FROM O")
add("argsort_axis1", lambda s, d: sorting.argsort(_e(s, d), 1), f"WITH {E} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, i1 AS v FROM E")
add("partition", lambda s, d: sorting.partition(_o(s, d), 100), f"WITH {O} SELECT row_number() OVER (ORDER BY v) - 1 AS i0, v FROM O")
add("argpartition", lambda s, d: sorting.argpartition(_k(s, d), 100), f"WITH {K} SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, i0 AS v FROM K")
add("topk_row", lambda s, d: sorting.topk(_e(s, d), 5), f"WITH {E} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) - 1 AS i1, i1 AS v FROM E QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) <= 5")
add("scan_flat", lambda s, d: sorting.scan(_k(s, d)), f"WITH {K} SELECT i0, sum(v) OVER (ORDER BY i0)::BIGINT AS v FROM K")
add("scan_axis0", lambda s, d: sorting.scan(_e(s, d), axis=0), f"WITH {E} SELECT i0, i1, round(sum(v) OVER (PARTITION BY i1 ORDER BY i0), 5) AS v FROM E", 5)
add("scan_axis1_max", lambda s, d: sorting.scan(_e(s, d), np.max, np.maximum.accumulate, 1), f"WITH {E} SELECT i0, i1, max(v) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM E")

# images: vectors as 8 by 8 pictures

_IM = f"{E}, M AS (SELECT i0, 0::BIGINT AS i1, i1 // 8 AS i2, i1 % 8 AS i3, v FROM E)"


def _unsigned(x: GridArray, digits: int) -> DataFrame:
    """Rounded, without negative zeros."""
    return x.frame().withColumn("v", F.round("v", digits) + 0.0)


_images = lambda s, d: _e(s, d).reshape(-1, 1, 8, 8)
_FILTER = np.arange(1.0, 19.0).reshape(2, 1, 3, 3)
add("stencil", lambda s, d: _unsigned(image.stencil(_images(s, d), _FILTER), 4), f"WITH {_IM}, f AS (SELECT x // 9 AS f, x % 9 // 3 AS dx, x % 3 AS dy, x + 1 AS w FROM range(18) t(x)) SELECT i0, f AS i1, i2 - dx AS i2, i3 - dy AS i3, round(sum(v * w), 4) + 0.0 AS v FROM M, f WHERE i2 >= dx AND i3 >= dy GROUP BY ALL")
add("maxpool", lambda s, d: image.maxpool(_images(s, d)), f"WITH {_IM} SELECT i0, i1, i2 // 2 AS i2, i3 // 2 AS i3, max(v) AS v FROM M GROUP BY ALL")
add(
    "convnet",
    lambda s, d: _unsigned(image.convnet(_images(s, d), [_FILTER, np.ones((1, 2, 2, 2))]), 4),
    f"""WITH {_IM}, f AS (SELECT x // 9 AS f, x % 9 // 3 AS dx, x % 3 AS dy, x + 1 AS w FROM range(18) t(x)), g AS (SELECT x // 2 AS dx, x % 2 AS dy FROM range(4) t(x)),
a AS (SELECT i0, f AS i1, i2 - dx AS i2, i3 - dy AS i3, sum(v * w) AS v FROM M, f WHERE i2 >= dx AND i3 >= dy GROUP BY ALL), b AS (SELECT i0, i1, i2 // 2 AS i2, i3 // 2 AS i3, max(v) AS v FROM a GROUP BY ALL),
c AS (SELECT i0, i2 - dx AS i2, i3 - dy AS i3, sum(v) AS v FROM b, g WHERE i2 >= dx AND i3 >= dy GROUP BY ALL) SELECT i0, 0::BIGINT AS i1, i2 // 2 AS i2, i3 // 2 AS i3, round(max(v), 4) + 0.0 AS v FROM c GROUP BY ALL""",
)

# storage

add("save_load", lambda s, d: _round_trip(s, d), f"WITH {P} SELECT i0, v FROM P")
add("partial_load", lambda s, d: _round_trip(s, d, [((10, 60),)]), f"WITH {P} SELECT i0, v FROM P WHERE i0 BETWEEN 10 AND 59")
add("pickle_unpickle", lambda s, d: _round_trip(s, d), f"WITH {P} SELECT i0, v FROM P")
add("checkpoint", lambda s, d: arrays.checkpoint(_p(s, d) * 2.0), f"WITH {P} SELECT i0, v * 2 AS v FROM P")
add("from_numpy", lambda s, d: arrays.from_numpy(np.arange(600.0).reshape(20, 30), s), "SELECT (i // 30)::BIGINT AS i0, (i % 30)::BIGINT AS i1, i::DOUBLE AS v FROM range(600) t(i)")
add("from_file_matrix_market", lambda s, d: _matrix_market(s, d), f"WITH {U} SELECT i0, i1, v FROM U")


def _round_trip(s, d, boxes=None):
    x, path = _p(s, d), f"{shared_dir(s)}/arrays-{uuid.uuid4().hex}"
    arrays.save(x, "p", path, tile=(50,) if x.size <= 5000 else (5000,))
    return arrays.load("p", path, spark=s) if boxes is None else arrays.partial_load(boxes, "p", path, spark=s)


def _matrix_market(s, d):
    """Written as text by Spark, read as a Matrix Market file."""
    x, path = _u(s, d), f"{shared_dir(s)}/mm-{uuid.uuid4().hex}"
    cells = x.frame().select(F.concat_ws(" ", F.col("i0") + 1, F.col("i1") + 1, "v").alias("value"), F.lit(2).alias("o"))
    head = s.createDataFrame([("%%MatrixMarket matrix coordinate integer general", 0), (f"{x.shape[0]} {x.shape[1]} {cells.count()}", 1)], "value string, o int")
    head.unionByName(cells).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return arrays.from_file(path, "mm", spark=s)


# algorithms


def _counts(s, d):
    """(doc, term, n, label): words of labelled documents, the label their quality."""
    labels = table(s, d, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    words = table(s, d, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("doc"), F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("term"), "label").where("length(term) > 2")
    return kept(words.groupBy("doc", "term", "label").agg(F.count("*").alias("n")))  # used several times: texts are split once


_COUNTS = """lab AS (SELECT doc_id, max(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term, label FROM documents JOIN lab USING (doc_id)),
c AS (SELECT doc, term, label, count(*) AS n FROM w WHERE length(term) > 2 GROUP BY ALL)"""
_MODEL = f"""{_COUNTS}, df AS (SELECT term, count(*) AS df FROM c GROUP BY term), nd AS (SELECT count(DISTINCT doc) AS n FROM c),
tf AS (SELECT doc, term, label, c.n * (ln(nd.n::DOUBLE / (df + 1)) + 1) AS v FROM c JOIN df USING (term), nd),
sc AS (SELECT doc, sqrt(sum(v * v)) AS r FROM tf GROUP BY doc),
bl AS (SELECT label, term, sum(v / r) AS w FROM tf JOIN sc USING (doc) GROUP BY ALL),
g AS (SELECT l.label, t.term, coalesce(bl.w, 0) + 1 AS w FROM (SELECT DISTINCT label FROM c) l CROSS JOIN (SELECT DISTINCT term FROM c) t LEFT JOIN bl ON bl.label = l.label AND bl.term = t.term),
m AS (SELECT label, term, ln(w / sum(w) OVER (PARTITION BY label)) AS weight FROM g)"""


def _bayes(s, d):
    counts = _counts(s, d)
    return learning.naive_bayes(counts, counts.select("doc").distinct().count()), counts


add("naive_bayes_fit", lambda s, d: _bayes(s, d)[0].select("label", "term", F.round("weight", 6).alias("weight")), f"WITH {_MODEL} SELECT label, term, round(weight, 6) AS weight FROM m")
add(
    "naive_bayes_predict",
    lambda s, d: (lambda m, c: learning.naive_bayes_predict(m, c.drop("label")))(*_bayes(s, d)),
    f"WITH {_MODEL}, p AS (SELECT doc, m.label, round(sum(n * weight), 9) AS s FROM c JOIN m USING (term) GROUP BY ALL) SELECT doc, label FROM p QUALIFY row_number() OVER (PARTITION BY doc ORDER BY s DESC, label) = 1",
)
_parts = lambda s, d: table(s, d, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("v"))
_SIM = """r AS (SELECT l_suppkey AS u, l_partkey AS item, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), nr AS (SELECT item, sqrt(sum(v * v)) AS r FROM r GROUP BY item),
x AS (SELECT u, item, v / nr.r AS v FROM r JOIN nr USING (item)), s AS (SELECT a.item, b.item AS other, sum(a.v * b.v) AS s FROM x a JOIN x b USING (u) GROUP BY ALL)"""
add("item_similarity", lambda s, d: learning.item_similarity(_parts(s, d), 5).select("item", "rank", "other", F.round("similarity", 6).alias("v")), f"WITH {_SIM} SELECT item, row_number() OVER (PARTITION BY item ORDER BY round(s, 9) DESC, other)::INTEGER AS rank, other, round(s, 6) AS v FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(s, 9) DESC, other) <= 5")
add("knn", lambda s, d: learning.knn(_rows(s, d), _rows(s, d).where("i0 % 100 = 0"), 10).select("query", "rank", "i0", F.round("distance", 6).alias("v")), f"WITH {E}, s AS (SELECT a.i0 AS query, b.i0, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS x FROM E a JOIN E b ON a.i1 = b.i1 AND a.i0 % 100 = 0 GROUP BY a.i0, b.i0) SELECT query, row_number() OVER (PARTITION BY query ORDER BY x, i0)::INTEGER AS rank, i0, round(x, 6) AS v FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY x, i0) <= 10")


def _first(s, d, k=5):
    return np.array([r.x for r in _rows(s, d).where(F.col("i0") < k).orderBy("i0").collect()])


def _center_frame(s, centers):
    i, j = np.indices(centers.shape).reshape(2, -1)
    return s.createDataFrame([(int(a), int(b), float(centers[a, b])) for a, b in zip(i, j)], "i0 long, i1 long, v double")


def _kmeans_sql(rounds: int) -> str:
    out = f"WITH {E}, c0 AS (SELECT i0 AS k, i1, v FROM E WHERE i0 < 5)"
    for n in range(rounds):
        out += f""", d{n} AS (SELECT E.i0, k, sum((E.v - c.v) * (E.v - c.v)) AS x FROM E JOIN c{n} c ON c.i1 = E.i1 GROUP BY ALL),
a{n} AS (SELECT i0, k FROM d{n} QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY x, k) = 1),
n{n} AS (SELECT k, i1, avg(v) AS v FROM E JOIN a{n} USING (i0) GROUP BY ALL),
c{n + 1} AS (SELECT c.k, c.i1, coalesce(n.v, c.v) AS v FROM c{n} c LEFT JOIN n{n} n ON n.k = c.k AND n.i1 = c.i1)"""
    return out + f" SELECT k AS i0, i1, round(v, 5) AS v FROM c{rounds}"


for rounds in (1, 5):
    add(f"kmeans_{rounds}", lambda s, d, n=rounds: _center_frame(s, clustering.kmeans(_rows(s, d), _first(s, d), n)), _kmeans_sql(rounds), 5)
add("kmeans_assign", lambda s, d: clustering.assign(_rows(s, d), _first(s, d)).select("i0", F.col("label").alias("v")), f"WITH {E}, s AS (SELECT a.i0, b.i0 AS k, sum((a.v - b.v) * (a.v - b.v)) AS x FROM E a JOIN E b ON a.i1 = b.i1 AND b.i0 < 5 GROUP BY ALL) SELECT i0, k AS v FROM s QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY x, k) = 1")

def _fuzzy_sql(rounds: int) -> str:
    out = f"WITH {E}, c0 AS (SELECT i0 AS k, i1, v FROM E WHERE i0 < 5)"
    for n in range(rounds):
        out += f""", d{n} AS (SELECT E.i0, k, 1 / greatest(sum((E.v - c.v) * (E.v - c.v)), 1e-300) AS w FROM E JOIN c{n} c ON c.i1 = E.i1 GROUP BY ALL),
m{n} AS (SELECT i0, k, pow(w / sum(w) OVER (PARTITION BY i0), 2) AS w FROM d{n}),
c{n + 1} AS (SELECT k, i1, sum(w * v) / sum(w) AS v FROM E JOIN m{n} USING (i0) GROUP BY ALL)"""
    return out + f" SELECT k AS i0, i1, round(v, 5) AS v FROM c{rounds}"


add("fuzzy_kmeans", lambda s, d: _center_frame(s, clustering.fuzzy_kmeans(_rows(s, d), _first(s, d), 3)), _fuzzy_sql(3), 5)
add("canopies", lambda s, d: _center_frame(s, clustering.canopies(_rows(s, d), 12.0, 10.0)), None, 5)
add("streaming_kmeans", lambda s, d: _center_frame(s, clustering.streaming_kmeans(_rows(s, d), 10)), None, 5)
add("spectral_clustering", lambda s, d: clustering.spectral(_rows(s, d), _e(s, d).shape[0], 5, gamma=0.05))
_links = lambda s, d: _l(s, d).frame().select(F.col("i0").alias("source"), F.col("i1").alias("target"), "v")
add("pagerank_step", lambda s, d: simulation.pagerank(_links(s, d).select("source", "target", (F.col("v") / 50.0).alias("weight")), _l(s, d).shape[0], 1).select("i0", "v"), f"WITH {L}, n AS (SELECT max(l_orderkey) + 1 AS n FROM lineitem) SELECT i1 AS i0, round(sum(v / 50 / n), 9) AS v FROM L, n GROUP BY i1", 9)
add("black_scholes", lambda s, d: _options(s, d), None)
_BS = {"x": "(o_totalprice / 1000 + 1)", "k": "(o_totalprice / 1000 + 2)"}


def _options(s, d):
    x = F.col("o_totalprice") / 1000 + 1
    call, put = simulation.black_scholes(x, x + 1, F.lit(2.0), 0.01, 0.2)
    return table(s, d, "orders").select(F.col("o_orderkey").alias("i0"), F.round(call, 5).alias("call"), F.round(put, 5).alias("put"))


def _cdf_sql(z: str) -> str:
    k, series = f"(1 / (1 + {numeric.CDF_SCALE} * abs({z})))", "0"
    for term in reversed(numeric.CDF_TERMS):
        series = f"(({series} + ({term})) * {k})"
    tail = f"({numeric.CDF_NORM} * exp(-{z} * {z} / 2) * {series})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


ORACLES["black_scholes"] = f"""WITH t AS (SELECT o_orderkey AS i0, o_totalprice / 1000 + 1 AS x FROM orders),
a AS (SELECT *, (ln(x / (x + 1)) + (0.01 + 0.5 * 0.2 * 0.2) * 2) / (0.2 * sqrt(2)) AS d1 FROM t), b AS (SELECT *, d1 - 0.2 * sqrt(2) AS d2, -d1 AS e1, -(d1 - 0.2 * sqrt(2)) AS e2, (x + 1) * exp(-0.02) AS k FROM a)
SELECT i0, round(x * {_cdf_sql('d1')} - k * {_cdf_sql('d2')}, 5) AS "call", round(k * {_cdf_sql('e2')} - x * {_cdf_sql('e1')}, 5) AS put FROM b"""
add("find_change", lambda s, d: simulation.find_change(_v(s, d), 0.5), f"WITH {V}, l AS (SELECT i0 - 1 AS i0, (v - lag(v) OVER (ORDER BY i0)) / lag(v) OVER (ORDER BY i0) AS v FROM V) SELECT i0, round(v, 6) AS v FROM l WHERE abs(v) > 0.5", 6)
add("predict_price", lambda s, d: _named(s, ["slope", "intercept"], simulation.predict_price(_v(s, d), 5)), f"WITH {V}, l AS (SELECT v AS y, lag(v, 5) OVER (ORDER BY i0) AS x FROM V) SELECT 'slope' AS name, round(regr_slope(y, x), 6) AS v FROM l UNION ALL SELECT 'intercept', round(regr_intercept(y, x), 6) FROM l", 6)
add("pearson", lambda s, d: _one(s, simulation.pearson(_o(s, d), _k(s, d))), f"WITH {O}, {K} SELECT round(corr(O.v, K.v), 8) AS v FROM O JOIN K USING (i0)", 8)


def _named(s, names, values):
    return s.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "name string, v double")


_lines = lambda s, d: table(s, d, "lineitem").select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"))


def _gd_sql(rounds: int, model: str = "a * p + b * q", y: str = "y", penalty: float = 0.0) -> str:
    out = "WITH t AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_extendedprice / 1e5 AS y FROM lineitem), w0 AS (SELECT 0::DOUBLE AS p, 0::DOUBLE AS q)"
    for n in range(rounds):
        out += f", w{n + 1} AS (SELECT any_value(p) - 1e-6 * (sum(a * ({model} - {y})) + {penalty} * any_value(p)) AS p, any_value(q) - 1e-6 * (sum(b * ({model} - {y})) + {penalty} * any_value(q)) AS q FROM t, w{n})"
    return out + f" SELECT 'quantity' AS name, round(p, 9) AS v FROM w{rounds} UNION ALL SELECT 'discount', round(q, 9) FROM w{rounds}"


add("linear_regression_gd", lambda s, d: _named(s, ["quantity", "discount"], learning.linear_regression(_lines(s, d), 2, 1e-6, 5)), _gd_sql(5), 9)
add("logistic_regression_gd", lambda s, d: _named(s, ["quantity", "discount"], learning.logistic_regression(_lines(s, d).withColumn("y", (F.col("y") > 0.4).cast("double")), 2, 1e-6, 5)), _gd_sql(5, "1 / (1 + exp(-(a * p + b * q)))", "(y > 0.4)::INTEGER"), 9)
add("ridge_regression_gd", lambda s, d: _named(s, ["quantity", "discount"], learning.ridge_regression(_lines(s, d), 2, 10.0, 1e-6, 5)), _gd_sql(5, penalty=10.0), 9)
add("least_squares", lambda s, d: _named(s, ["slope", "intercept"], (lambda r: (r[0][0], r[1]))(learning.least_squares(table(s, d, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), 1))), "SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS v FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem", 4)
_signed = lambda s, d: table(s, d, "embeddings").select(F.col("vec_id").alias("i0"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))
add("svm", lambda s, d: _named(s, [f"w{k}" for k in range(64)], learning.svm_dual(_signed(s, d), 64, rounds=3)))
add("random_forest", lambda s, d: learning.random_forest(table(s, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("x")), "label", trees=10, depth=5).transform(_features(s, d)).select("i0", F.col("prediction").cast("long").alias("v")))
add("perceptron", lambda s, d: _named(s, ["mean"], [np.mean([np.abs(w).mean() for w in learning.multilayer(table(s, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").alias("y")), [64, 16, 10], 3)])]))


def _features(s, d):
    from pyspark.ml.functions import array_to_vector

    return _rows(s, d).select("i0", array_to_vector("x").alias("features"))


add("pca", lambda s, d: _named(s, [f"v{k}" for k in range(5)], decomposition.pca(_rows(s, d), 64, 5)[2]), None, 6)
add("svd", lambda s, d: _named(s, [f"s{k}" for k in range(3)], decomposition.svds(_e(s, d), 3)[1]), None, 6)
add("ssvd", lambda s, d: _named(s, [f"s{k}" for k in range(3)], decomposition.ssvd(_rows(s, d), 64, 3)[0]), None, 3)


def _gram_sql(value: str) -> str:
    return f"{E}, g AS (SELECT a.i1 AS i, b.i1 AS j, sum(a.v * b.v) AS v FROM E a JOIN E b USING (i0) GROUP BY ALL), A AS MATERIALIZED (SELECT i, j, {value} AS v FROM g)"


#: Rows (i, j, v) of the lower factor l of A, a column for each step of the recursion.
_FACTOR = """, S(k, i, j, v) AS (SELECT 0::BIGINT, i, j, v FROM A WHERE i >= j UNION ALL
SELECT s.k + 1, s.i, s.j, s.v - a.v * b.v / d.v FROM S s JOIN S a ON a.i = s.i AND a.j = s.k JOIN S b ON b.i = s.j AND b.j = s.k JOIN S d ON d.i = s.k AND d.j = s.k WHERE s.j > s.k),
l AS (SELECT s.i, s.j, s.v / sqrt(d.v) AS v FROM S s JOIN S d ON d.k = s.j AND d.i = s.j AND d.j = s.j WHERE s.k = s.j)"""


def _jacobi_sql(rounds: int) -> str:
    out = f"WITH {_gram_sql('v / 1e6 + CASE WHEN i = j THEN 10 ELSE 0 END')}, x0 AS (SELECT DISTINCT i, 0::DOUBLE AS v FROM A)"
    for n in range(rounds):
        out += f", x{n + 1} AS MATERIALIZED (SELECT A.i, (A.i - sum(CASE WHEN A.i <> A.j THEN A.v * x.v ELSE 0 END)) / max(CASE WHEN A.i = A.j THEN A.v END) AS v FROM A JOIN x{n} x ON x.i = A.j GROUP BY A.i)"
    return out + f" SELECT 'x' || i AS name, round(v, 6) AS v FROM x{rounds}"


def _cg_sql(rounds: int) -> str:
    out = f"WITH {_gram_sql('v / 1e3 + CASE WHEN i = j THEN 1 ELSE 0 END')}, s0 AS (SELECT DISTINCT i, 0::DOUBLE AS x, i::DOUBLE AS r, i::DOUBLE AS p FROM A)"
    for n in range(rounds):
        out += f""", q{n} AS MATERIALIZED (SELECT A.i, sum(A.v * s.p) AS q FROM A JOIN s{n} s ON s.i = A.j GROUP BY A.i), k{n} AS MATERIALIZED (SELECT sum(r * r) AS rr, CASE WHEN sum(r * r) > 1e-10 THEN sum(r * r) / sum(p * q) ELSE 0 END AS step FROM s{n} JOIN q{n} USING (i)),
t{n} AS MATERIALIZED (SELECT i, x + step * p AS x, r - step * q AS r, p FROM s{n} JOIN q{n} USING (i) CROSS JOIN k{n}), s{n + 1} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM t{n}) / (SELECT rr FROM k{n}) * p AS p FROM t{n})"""
    return out + f" SELECT 'x' || i AS name, round(x, 6) AS v FROM s{rounds}"


add("qr", lambda s, d: _center_frame(s, decomposition.qr(_rows(s, d), 64)[1] + 0.0), f"WITH RECURSIVE {_gram_sql('v')}{_FACTOR} SELECT A.j AS i0, A.i AS i1, round(coalesce(l.v, 0), 6) + 0.0 AS v FROM A LEFT JOIN l USING (i, j)", 6)
add("cholesky", lambda s, d: decomposition.cholesky(linalg.dot(_e(s, d).T, _e(s, d)) + creation.eye(64, dtype="float64"), 32), f"WITH RECURSIVE {_gram_sql('v + CASE WHEN i = j THEN 1 ELSE 0 END')}{_FACTOR} SELECT i AS i0, j AS i1, round(v, 6) AS v FROM l", 6)
add("jacobi", lambda s, d: _named(s, [f"x{k}" for k in range(64)], decomposition.jacobi(linalg.dot(_e(s, d).T, _e(s, d)) / 1e6 + creation.eye(64, dtype="float64") * 10.0, np.arange(64.0), 5)), _jacobi_sql(5), 6)
add("conjugate_gradient", lambda s, d: _named(s, [f"x{k}" for k in range(64)], decomposition.conjugate_gradient(linalg.dot(_e(s, d).T, _e(s, d)) / 1e3 + creation.eye(64, dtype="float64"), np.arange(64.0), 5)), _cg_sql(5), 6)


def _sides(users: DataFrame, items: DataFrame) -> DataFrame:
    """(side, i0, x): the factors of users and of items."""
    both = [f.select(F.lit(side).alias("side"), F.col("id").cast("long").alias("i0"), F.col(x).alias("x")) for side, f, x in (("user", users, users.columns[1]), ("item", items, items.columns[1]))]
    return both[0].unionByName(both[1])


def _als(s, d, implicit=False):
    model = learning.als(_parts(s, d), 5, iterations=3, implicit=implicit)
    return _sides(model.userFactors, model.itemFactors)


add("als", lambda s, d: _als(s, d))
add("als_implicit", lambda s, d: _als(s, d, True))
add("sgd_factors", lambda s, d: _sides(*learning.sgd_factors(_parts(s, d).withColumn("v", F.col("v") / 50), 5, epochs=1, parts=2)))
add("lda", lambda s, d: _topics(s, d), None, 12)  # shares of rare terms are far below 1e-6
add("isomap", lambda s, d: _center_frame(s, simulation.isomap(_rows(s, d), _e(s, d).shape[0], 6, 2)), None, 5)


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if kind == "double" else n for n, kind in df.dtypes])


_NBODY = """WITH b AS (SELECT s_suppkey::BIGINT AS i0, abs(s_acctbal) / 1e4 AS m, s_suppkey * 7 % 101 / 10.0 AS x, s_suppkey * 13 % 101 / 10.0 AS y, s_suppkey * 29 % 101 / 10.0 AS z FROM supplier),
p AS (SELECT a.i0, b.m, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM b a JOIN b ON a.i0 <> b.i0), q AS (SELECT *, m / pow(dx * dx + dy * dy + dz * dz + 1e-3, 1.5) AS f FROM p),
f AS (SELECT i0, 0.01 * sum(dx * f) AS vx, 0.01 * sum(dy * f) AS vy, 0.01 * sum(dz * f) AS vz FROM q GROUP BY i0)
SELECT i0, round(m, 9) AS m, round(x + 0.01 * vx, 9) AS x, round(y + 0.01 * vy, 9) AS y, round(z + 0.01 * vz, 9) AS z, round(vx, 9) AS vx, round(vy, 9) AS vy, round(vz, 9) AS vz FROM b JOIN f USING (i0)"""
add("nbody", lambda s, d: _rounded(simulation.nbody(table(s, d, "supplier").select(F.col("s_suppkey").alias("i0"), (F.abs("s_acctbal") / 1e4).alias("m"), *[(F.pmod(F.col("s_suppkey") * p, F.lit(101)) / 10.0).alias(c) for c, p in zip("xyz", (7, 13, 29))], *[F.lit(0.0).alias(f"v{c}") for c in "xyz"]), 1), 9), _NBODY)
add("swaption", lambda s, d: _named(s, ["price", "error"], simulation.swaption(s, 20000, [0.05] * 8, 0.05, 0.2, start=4)))
add("stream_running_totals", lambda s, d: streaming.totals_so_far(s, table(s, d, "events").schema, f"{d}/events.parquet"), "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")


def _topics(s, d):
    """(i0, term, v): the topics' shares of every term of the labelled documents."""
    return learning.lda_table(_counts(s, d).drop("label"), 5, 3).select(F.col("topic").alias("i0"), "term", "v")


# the flagship


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors against the centroids of their labels: the label of the largest cosine for every vector, and whether it is its own."""
    vectors = table(spark, d, "embeddings")
    e = from_vectors(vectors, "vec_id", "embedding")
    cells = e.frame()
    length = cells.groupBy("i0").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("r"))
    unit = cells.join(length, "i0").select("i0", "i1", numeric.true_div(F.col("v"), F.col("r")).alias("v"))
    labels = vectors.select(F.col("vec_id").alias("i0"), "label")
    centroids = unit.join(labels, "i0").groupBy("label", "i1").agg(F.avg("v").alias("c"))  # labels by components: small
    scores = unit.join(F.broadcast(centroids), "i1").groupBy("i0", "label").agg(F.round(F.sum(F.col("v") * F.col("c")), 9).alias("s"))
    best = scores.groupBy("i0").agg(F.max_by("label", F.struct("s", (-F.col("label")).alias("l"))).alias("best"))
    return best.join(labels, "i0").select("i0", "label", "best", (F.col("label") == F.col("best")).alias("own"))


add("label_by_centroid", flagship, f"""WITH {E}, r AS (SELECT i0, sqrt(sum(v * v)) AS r FROM E GROUP BY i0), u AS (SELECT E.i0, i1, v / r AS v FROM E JOIN r USING (i0)),
c AS (SELECT label, i1, avg(v) AS c FROM u JOIN embeddings ON vec_id = i0 GROUP BY ALL), s AS (SELECT i0, c.label, round(sum(v * c), 9) AS s FROM u JOIN c USING (i1) GROUP BY ALL),
b AS (SELECT i0, label AS best FROM s QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY s DESC, label) = 1) SELECT i0, label, best, label = best AS own FROM b JOIN embeddings ON vec_id = i0""")
