"""Algorithms against NumPy on small data."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.algorithms import clustering, decomposition, learning, simulation
from gridloom.sources import arrays

R = np.random.default_rng(5)
X = R.normal(size=(80, 6))


@pytest.fixture
def rows(spark):
    return lambda x, **more: spark.createDataFrame(pa.table({"i0": pa.array(np.arange(len(x))), "x": pa.array(x.tolist(), pa.list_(pa.float64())), **{k: pa.array(v) for k, v in more.items()}}))


def test_kmeans(rows):
    c = X[:4]
    for _ in range(5):
        label = ((X[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([X[label == k].mean(0) if (label == k).any() else c[k] for k in range(4)])
    assert np.allclose(clustering.kmeans(rows(X), X[:4], 5), c)
    got = clustering.assign(rows(X), c).orderBy("i0").toPandas()
    assert (got.label.to_numpy() == ((X[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()


def blobs():
    return np.concatenate([R.normal(size=(60, 2)) * 0.2 + m for m in ((0, 0), (5, 5), (0, 6))])


def near(found, means=((0, 0), (5, 5), (0, 6))):
    return all(min(np.abs(np.array(m) - f).max() for f in found) < 0.5 for m in means)


def test_clusters_of_blobs(rows):
    x = blobs()
    assert near(clustering.fuzzy_kmeans(rows(x), x[[0, 60, 120]], 5))
    assert near(clustering.streaming_kmeans(rows(x), 3, 40))
    found = clustering.canopies(rows(x), 2.5, 2.0)
    assert len(found) == 3 and near(found)
    got = clustering.spectral(rows(x), len(x), 3, gamma=0.5).orderBy("i0").toPandas().label.to_numpy()
    assert len({got[0], got[60], got[120]}) == 3 and all((got[a : a + 60] == got[a]).all() for a in (0, 60, 120))


def test_decompositions(spark, rows):
    g = arrays.from_numpy(X, spark)
    u, s, vt = decomposition.svds(g, 3)
    want = np.linalg.svd(X, full_matrices=False)
    assert np.allclose(s, want[1][:3]) and np.allclose(np.abs(vt), np.abs(want[2][:3]), atol=1e-6) and np.allclose(np.abs(u), np.abs(want[0][:, :3]), atol=1e-6)
    _, axes, values = decomposition.pca(rows(X), 6, 2)
    c = np.linalg.svd(X - X.mean(0), full_matrices=False)
    assert np.allclose(values, c[1][:2] ** 2 / 79) and np.allclose(np.abs(axes), np.abs(c[2][:2]), atol=1e-6)
    q, r = decomposition.qr(rows(X), 6)
    q = np.array([x.x for x in q.orderBy("i0").collect()])
    assert np.allclose(q @ r, X) and np.allclose(q.T @ q, np.eye(6)) and np.allclose(r, np.triu(r))
    assert np.allclose(decomposition.ssvd(rows(X), 6, 3)[0], want[1][:3])
    spd = X.T @ X + np.eye(6)
    g = arrays.from_numpy(spd, spark)
    assert np.allclose(decomposition.cholesky(g, 2).glom(), np.linalg.cholesky(spd))
    b = np.arange(6.0)
    assert np.allclose(decomposition.conjugate_gradient(g, b), np.linalg.solve(spd, b))
    dom = R.random((6, 6)) + 10 * np.eye(6)
    assert np.allclose(decomposition.jacobi(arrays.from_numpy(dom, spark), b), np.linalg.solve(dom, b))


def test_regressions(rows):
    w = np.array([1.0, -2, 3, 0, 0.5, 1])
    y = X @ w + 4
    got, c = learning.least_squares(rows(X, y=y), 6)
    assert np.allclose(got, w) and abs(c - 4) < 1e-9
    assert np.allclose(learning.linear_regression(rows(X, y=y - 4), 6, 5e-3, 60), w, atol=0.05)
    ridge = learning.ridge_regression(rows(X, y=y - 4), 6, 5.0, 5e-3, 60)
    assert np.allclose(ridge, np.linalg.solve(X.T @ X + 5 * np.eye(6), X.T @ (y - 4)), atol=0.05)
    label = (X @ w > 0).astype(float)
    found = learning.logistic_regression(rows(X, y=label), 6, 0.05, 40)
    assert ((X @ found > 0) == (label > 0)).mean() > 0.95


def test_classifiers(rows):
    w = np.array([1.0, -2, 3, 0, 0.5, 1])
    y = np.where(X @ w > 0, 1, -1)
    found = learning.svm_dual(rows(X, y=y), 6, rounds=5)
    assert (np.sign(X @ found) == y).mean() > 0.9
    alpha, b = learning.svm_smo(X, y.astype(float), 10.0)
    assert (np.sign((alpha * y) @ (X @ X.T) + b) == y).mean() > 0.95
    x = blobs()
    net = learning.multilayer(rows(x / 5, y=np.repeat([0, 1, 2], 60)), [2, 8, 3], 150, 2.0)
    assert (learning.multilayer_predict(x / 5, net) == np.repeat([0, 1, 2], 60)).mean() > 0.95
    from pyspark.ml.functions import array_to_vector

    data = rows(x, label=np.repeat([0, 1, 2], 60))
    model = learning.random_forest(data, "label", trees=10)
    assert model.transform(data.withColumn("features", array_to_vector("x"))).where("label = prediction").count() > 170


def test_knn(rows):
    got = learning.knn(rows(X), rows(X[:7]), 3, 12).orderBy("query", "rank").toPandas()
    d = np.sqrt(((X[:7, None] - X[None]) ** 2).sum(2))
    assert (got.i0.to_numpy().reshape(7, 3) == np.argsort(d, 1)[:, :3]).all() and np.allclose(got.distance.to_numpy().reshape(7, 3), np.sort(d, 1)[:, :3])


def test_factors(spark):
    u, m = R.random((30, 2)), R.random((20, 2))
    ratings = spark.createDataFrame([(int(i), int(j), float(u[i] @ m[j])) for i in range(30) for j in range(20)], "user long, item long, v double")
    users, items = learning.sgd_factors(ratings, 2, 0.1, 10, 2, 0.0)
    p, q = ({r.id: np.array(r.x) for r in f.collect()} for f in (users, items))
    assert np.mean([(p[i] @ q[j] - u[i] @ m[j]) ** 2 for i in range(30) for j in range(20)]) < 0.05
    model = learning.als(ratings, 2, 0.01, 8)
    assert model.transform(ratings).agg(F.avg((F.col("prediction") - F.col("v")) ** 2)).first()[0] < 0.01


def test_topics(spark):
    counts = spark.createDataFrame([(d, t + 5 * (d % 2), 3) for d in range(20) for t in range(5)], "doc long, term long, n long")
    model = learning.lda(counts, 2, 10, 15)
    assert np.allclose(model.sum(1), 1) and {tuple(np.sort(np.argsort(-m)[:5])) for m in model} == {(0, 1, 2, 3, 4), (5, 6, 7, 8, 9)}


def test_graphs(spark, rows):
    links = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "source long, target long, weight double")
    m = np.array([[0, 0, 1.0], [0.5, 0, 0], [0.5, 1, 0]])
    want = np.full(3, 1 / 3)
    for _ in range(20):
        want = 0.85 * m @ want + 0.05
    got = simulation.pagerank(links, 3, 20, 0.85).orderBy("i0").toPandas().v.to_numpy()
    assert np.allclose(got, want)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 1.0)], "a long, b long, w double")
    found = {(r.source, r.node): r.distance for r in simulation.shortest_paths(edges, spark.createDataFrame([(0,), (3,)], "source long")).collect()}
    assert found == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (3, 3): 0, (3, 4): 1}
    t = np.linspace(0, 3, 40)
    flat = simulation.isomap(rows(np.stack([np.cos(t), np.sin(t)], 1)), 40, 2, 1)[:, 0]
    assert abs(np.corrcoef(flat, t)[0, 1]) > 0.999


def test_finance_and_physics(spark):
    price, error = simulation.swaption(spark, 20000, [0.05] * 6, 0.05, 0.2, start=3)
    assert 0.001 < price < 0.05 and error < price / 10
    prices = arrays.from_numpy(np.array([1.0, 2.0, 2.1, 1.0, 1.01]), spark)
    assert np.allclose(simulation.find_change(prices, 0.3).glom(), [1, 0, -1.1 / 2.1, 0])
    bodies = spark.createDataFrame([(0, 1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "i0 long, m double, x double, y double, z double, vx double, vy double, vz double")
    out = simulation.nbody(bodies, 2).orderBy("i0").collect()
    assert out[0].vx > 0 and abs(out[0].vx + out[1].vx) < 1e-12
