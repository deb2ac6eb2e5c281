"""Queries without SQL that take whole tables, against brute force on the smallest ones."""

import numpy as np
import pytest

from gridloom import queries
from gridloom.algorithms import clustering, learning

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return np.array([r.embedding for r in spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()], float)


def squared(x):
    return ((x[:, None] - x[None]) ** 2).sum(2)


def test_outer_of_all_rows(spark, vectors):
    got = queries.QUERIES["outer_distances"](spark, DIR).toPandas()
    want = squared(vectors)
    assert len(got) == want.size and np.allclose(want[got.i0, got.i1], got.v, atol=1e-5)


def test_spectral_of_all_rows(spark, vectors):
    got = queries.QUERIES["spectral_clustering"](spark, DIR).toPandas()
    assert sorted(got.i0) == list(range(len(vectors))) and got.label.nunique() == 5


@pytest.mark.parametrize("kind", ["rbf", "euclidean", "manhattan"])
def test_similarity_product(spark, vectors, kind, monkeypatch):
    n = len(vectors)
    gap = squared(vectors)
    want = {"rbf": np.exp(-0.05 * gap), "euclidean": 1 / (1 + np.sqrt(gap)), "manhattan": 1 / (1 + np.abs(vectors[:, None] - vectors[None]).sum(2))}[kind]
    x = np.random.default_rng(2).normal(size=n)
    assert np.allclose(clustering.similarity_product(queries._rows(spark, DIR), n, kind, 0.05, 64)(x), want @ x)
    monkeypatch.setattr(clustering, "PACKED", 0)
    assert np.allclose(clustering.similarity_product(queries._rows(spark, DIR), n, kind, 0.05, 64)(x), want @ x)


def test_isomap_of_all_rows(spark, vectors):
    n = len(vectors)
    d = np.sqrt(squared(vectors))
    graph = np.full((n, n), np.inf)
    for i, row in enumerate(np.argsort(d, 1, kind="stable")[:, 1:7]):
        graph[i, row] = graph[row, i] = d[i, row]
    np.fill_diagonal(graph, 0)
    for k in range(n):
        graph = np.minimum(graph, graph[:, k : k + 1] + graph[k : k + 1])
    graph = np.where(np.isinf(graph), graph[np.isfinite(graph)].max(), graph)
    centre = np.eye(n) - 1 / n
    values = np.sort(np.linalg.eigvalsh(-0.5 * centre @ (graph * graph) @ centre))[::-1][:2]
    got = queries.QUERIES["isomap"](spark, DIR).toPandas()
    assert len(got) == 2 * n
    found = got.pivot(index="i0", columns="i1", values="v").to_numpy()
    assert np.allclose(found.T @ found, np.diag(values), rtol=1e-3, atol=1e-2)


def test_topics_of_all_terms(spark):
    got = queries.QUERIES["lda"](spark, DIR).toPandas()
    terms = {r.term for r in queries._counts(spark, DIR).select("term").distinct().collect()}
    assert len(terms) > 200 and set(got.term) == terms and len(got) == 5 * len(terms)
    assert np.allclose(got.groupby("i0").v.sum(), 1) and (got.v > 0).all()


def test_topic_table(spark):
    r = np.random.default_rng(4)
    n = r.integers(0, 4, (12, 30))
    counts = spark.createDataFrame([(int(i), f"t{j:02}", int(n[i, j])) for i, j in zip(*np.nonzero(n))], "doc long, term string, n long")
    shares = lambda turns: learning.lda_table(counts, 3, turns).toPandas().pivot(index="topic", columns="term", values="v").to_numpy()
    beta = shares(0)
    for _ in range(2):
        model = np.zeros_like(beta)
        for row in n.astype(float):
            theta = np.full(3, row.sum() / 3)
            for _ in range(10):
                x = beta * (theta + 0.1)[:, None]
                x /= x.sum(0)
                theta = x @ row
            model += x * row
        beta = (model + 0.1) / (model + 0.1).sum(1, keepdims=True)
    assert np.allclose(shares(2), beta)
    two = spark.createDataFrame([(d, f"w{t + 5 * (d % 2)}", 3) for d in range(20) for t in range(5)], "doc long, term string, n long")
    top = learning.lda_table(two, 2, 15).toPandas().sort_values("v").groupby("topic").term.apply(lambda x: tuple(sorted(x[-5:])))
    assert set(top) == {("w0", "w1", "w2", "w3", "w4"), ("w5", "w6", "w7", "w8", "w9")}


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.read.parquet(f"{DIR}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").sum("l_quantity").toPandas().set_axis(["user", "item", "v"], axis=1)


@pytest.mark.parametrize("name", ["als", "als_implicit", "sgd_factors"])
def test_factors_of_all_parts(spark, ratings, name):
    got = queries.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got[got.side == "user"].i0) == sorted(set(ratings.user)) and sorted(got[got.side == "item"].i0) == sorted(set(ratings.item))
    assert got.x.map(lambda x: len(x) == 5 and np.isfinite(np.array(x, float)).all()).all()


def test_parts_are_not_folded(spark, tmp_path):
    """Parts 200 apart are different items."""
    r = np.random.default_rng(8)
    lines = [(int(u), int(p) + 200 * int(k), float(v)) for u, p, k, v in zip(r.integers(0, 6, 300), r.integers(1, 9, 300), r.integers(0, 3, 300), r.integers(1, 50, 300))]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    items = sorted({p for _, p, _ in lines})
    m = np.zeros((len(items), 6))
    for u, p, v in lines:
        m[items.index(p), u] += v
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    want = {(items[i], rank + 1): items[j] for i in range(len(items)) for rank, j in enumerate(np.lexsort((items, -s[i]))[: min(5, (s[i] > 0).sum())])}
    got = queries.QUERIES["item_similarity"](spark, str(tmp_path)).collect()
    assert {(x.item, x["rank"]): x.other for x in got} == want
    sides = queries.QUERIES["als"](spark, str(tmp_path)).toPandas()
    assert sorted(sides[sides.side == "item"].i0) == items


@pytest.mark.parametrize("held, terms", [(1 << 22, 1 << 20), (40, 7)])
def test_similarity_by_blocks(spark, held, terms, monkeypatch):
    """No join of pairs, one block or several; ratings below zero and unknown users too."""
    monkeypatch.setattr(learning, "HELD", held)
    monkeypatch.setattr(learning, "TERMS", terms)
    r = np.random.default_rng(9)
    lines = [(int(u) if u else None, int(p), float(v)) for u, p, v in zip(r.integers(0, 30, 400), r.integers(0, 50, 400), r.integers(-3, 9, 400))]
    m = np.zeros((50, 30))
    for u, p, v in lines:
        m[p, u or 0] += v
    unit, met = m / np.linalg.norm(m, axis=1, keepdims=True), np.zeros((50, 30), bool)
    met[[p for _, p, _ in lines], [u or 0 for u, _, _ in lines]] = True
    s = np.round(unit[:, 1:] @ unit[:, 1:].T, 9)
    together = (met[:, 1:].astype(int) @ met[:, 1:].T) > 0
    want = {(i, rank + 1, int(j)): s[i, j] for i in range(50) for rank, j in enumerate([j for j in np.lexsort((np.arange(50), -s[i])) if together[i, j]][:5])}
    got = learning.item_similarity(spark.createDataFrame(lines, "user long, item long, v double"), 5)
    assert {(x.item, x["rank"], x.other): x.similarity for x in got.collect()} == pytest.approx(want, abs=1e-8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert held < 1 << 22 or "Join" not in plan


def test_nearest_in_bounded_parts(spark, monkeypatch):
    """A task holds few distances at once, and equal ones go by number, over all parts."""
    monkeypatch.setattr(learning, "CELLS", 40)
    r = np.random.default_rng(5)
    x = r.integers(0, 3, (90, 4)).astype(float)
    best = np.full((8, 0), np.inf), np.zeros((8, 0), np.int64)
    for low in range(0, 90, 7):
        best = learning._nearest(best, x[:8], x[low : low + 7], np.arange(low, min(low + 7, 90)), 5)
    d = squared(x)[:8]
    want = np.lexsort((np.broadcast_to(np.arange(90), d.shape), d), axis=1)[:, :5]
    assert (best[1] == want).all() and (best[0] == np.take_along_axis(d, want, 1)).all()
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i0 long, x array<double>")
    got = learning.knn(rows, rows.where("i0 < 8"), 5, block=12).orderBy("query", "rank").collect()
    assert [g.i0 for g in got] == want.ravel().tolist()


def test_similarity_product_stores_no_pairs(spark, vectors, monkeypatch):
    """Beyond PACKED numbers too, blocks meet without a join: what is kept are the rows, once."""
    written, tables = [], clustering.kept
    monkeypatch.setattr(clustering, "PACKED", 0)
    monkeypatch.setattr(clustering, "kept", lambda df: written.append(df) or tables(df))
    product = clustering.similarity_product(queries._rows(spark, DIR), len(vectors), size=64)
    product(np.ones(len(vectors)))
    assert len(written) == 1 and "Join" not in written[0]._jdf.queryExecution().executedPlan().toString()


def test_outer_by_blocks(spark, vectors):
    """Whole rows meet, not elements: no join on the shared axis; rows that miss elements sum over those they share."""
    from gridloom.array import from_table
    from gridloom.operators import linalg

    cells = [(i, k, float(i * 7 % 5 + k)) for i in range(9) for k in range(4) if (i, k) != (3, 2)]
    x = from_table(spark.createDataFrame(cells, "i long, k long, v double"), ["i", "k"], "v")
    by = {(i, k): v for i, k, v in cells}
    out = linalg.outer(x, x, lambda a, b: abs(a - b), vectorized=True)
    want = {(i, j): sum(abs(by[i, k] - by[j, k]) for k in range(4) if (i, k) in by and (j, k) in by) for i in range(9) for j in range(9)}
    assert {(r.i0, r.i1): r.v for r in out.frame().collect()} == want
    assert "HashJoin" not in out.df._jdf.queryExecution().executedPlan().toString()
    u = linalg.outer(x[:, 0], x[:, 0], lambda a, b: a * b, vectorized=True).glom()
    assert np.allclose(u, np.outer([by[i, 0] for i in range(9)], [by[i, 0] for i in range(9)]))


def test_bodies_by_groups(spark, monkeypatch):
    """Bodies of several groups pull each other without a join of pairs; a body alone has no pull, equal places and unknown masses none either."""
    from gridloom.algorithms import simulation

    monkeypatch.setattr(simulation, "SENT", 7)
    monkeypatch.setattr(simulation, "TILE", 4)
    r = np.random.default_rng(6)
    x, m = r.normal(size=(30, 3)), r.random(30)
    rows = [(3 * i, float(m[i]) if i != 11 else None, *map(float, x[i]), 0.0, 0.0, 0.0) for i in range(30)]
    schema = "i0 long, m double, x double, y double, z double, vx double, vy double, vz double"
    m[11] = 0
    gap = x[None] - x[:, None]
    r2 = (gap * gap).sum(2) + 1e-3
    want = 0.01 * (gap * (m[None] / r2**1.5)[:, :, None]).sum(1)
    got = sorted(simulation.nbody(spark.createDataFrame(rows, schema)).collect())
    assert np.allclose([(g.vx, g.vy, g.vz) for g in got], want)
    assert simulation.nbody(spark.createDataFrame(rows[:1], schema)).count() == 0
    called = simulation.pulls(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema), None, None, 1e-3)
    assert "Join" not in called._jdf.queryExecution().executedPlan().toString()


def test_strata_in_streams(spark):
    """A task holds its items and one user; the factors are those of the ratings taken by user and item, part after part."""
    r = np.random.default_rng(7)
    lines = [(int(u), int(i), float(v)) for u, i, v in zip(r.integers(0, 9, 200), r.integers(0, 14, 200), r.random(200))]
    frame = spark.createDataFrame(lines, "user long, item long, v double")
    start = {(side, x.id): np.array(x.x) for side, f in zip("um", learning.sgd_factors(frame, 4, epochs=0, parts=2)) for x in f.collect()}
    from pyspark.sql import functions as F

    dealt = [tuple(x) for x in frame.select("user", "item", "v", F.pmod(F.xxhash64("user"), F.lit(2)), F.pmod(F.xxhash64("item"), F.lit(2))).collect()]
    for s in range(2):
        for user, item, v, a, b in sorted(dealt):
            if (a + s) % 2 == b:
                p, q = start["u", user], start["m", item]
                e = v - p @ q
                start["u", user], start["m", item] = p + 0.01 * (e * q - 0.02 * p), q + 0.01 * (e * p - 0.02 * q)
    got = {(side, x.id): x.x for side, f in zip("um", learning.sgd_factors(frame, 4, epochs=1, parts=2)) for x in f.collect()}
    assert got.keys() == start.keys() and all(np.allclose(got[k], start[k], atol=1e-12) for k in got)
