"""Array operators against NumPy."""

from math import erf

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom.array import GridArray, NotShapeable, as_array, from_table
from gridloom.operators import creation, elementwise, image, indexing, kernels, linalg, reduction, sorting
from gridloom.plans import planner
from gridloom.sources import arrays

R = np.random.default_rng(0)
A, B = R.normal(size=(7, 5)), R.normal(size=(7, 5))
INTS = R.integers(-9, 9, (7, 5))
Z = A.copy()
Z[0, 0], Z[1, 1], Z[2, 2] = 0, np.nan, -0.0
SPARSE = np.where(np.abs(A) > 1, A, 0)
CUBE = R.normal(size=(4, 6, 5))


def same(got, want):
    got = got.glom() if isinstance(got, GridArray) else np.asarray(got)
    want = np.asarray(want)
    assert got.shape == want.shape
    assert np.allclose(got.astype(float), want.astype(float), equal_nan=True, rtol=1e-6, atol=1e-6), (got, want)


@pytest.fixture
def g(spark):
    return lambda x: arrays.from_numpy(x, spark)


def test_maps(g):
    a, b, i, z = g(A), g(B), g(INTS), g(Z)
    with np.errstate(all="ignore"):
        for got, want in [
            (a + b * 2 - 1, A + B * 2 - 1), (3 - a, 3 - A), (1 / z, 1 / Z), (elementwise.true_divide(a, z), A / Z), (i // 4, INTS // 4), (i / 4, INTS // 4), (i % -4, INTS % -4),
            (elementwise.fmod(i, 4), np.fmod(INTS, 4)), (elementwise.floor_divide(i, i - 3), np.floor_divide(INTS, INTS - 3)), (a // b, A // B), (a % b, A % B), (elementwise.log(z), np.log(Z)),
            (elementwise.sqrt(a), np.sqrt(A)), (elementwise.maximum(z, b), np.maximum(Z, B)), (elementwise.minimum(z, b), np.minimum(Z, B)), (elementwise.reciprocal(z), 1 / Z), (a**2, A**2), (abs(a), abs(A)),
            (z <= b, Z <= B), (z != z, Z != Z), (z == z, Z == Z), (z > b, Z > B), (b > z, B > Z), ((a > 0) ^ (b > 0), (A > 0) ^ (B > 0)), (~(a > 0), ~(A > 0)), ((a > 0) & (b > 0), (A > 0) & (B > 0)), ((a > 0) | (b > 0), (A > 0) | (B > 0)),
            (a.astype(int), A.astype(int)), (elementwise.where(a > 0, b, 0.0), np.where(A > 0, B, 0)), (elementwise.norm_cdf(a), np.vectorize(lambda t: 0.5 * (1 + erf(t / 2**0.5)))(A)), (a - a.mean(0), A - A.mean(0)),
        ]:
            same(got, want)


def test_broadcasting(g):
    x, y = R.normal(size=(5, 1, 4)), R.normal(size=(3, 1))
    same(g(x) * g(y), x * y)
    with pytest.raises(ValueError):
        g(A) + g(CUBE)


@pytest.mark.parametrize("name", ["sum", "prod", "max", "min", "mean", "std", "argmin", "argmax", "all", "any"])
def test_reductions(g, name):
    dense, sparse = g(A), elementwise.tocoo(g(SPARSE))
    for axis in (None, 0, 1, -1):
        same(getattr(dense, name)(axis), getattr(A, name)(axis=axis))
        same(getattr(sparse, name)(axis), getattr(SPARSE, name)(axis=axis))


def test_more_reductions(g):
    a = g(A)
    same(reduction.min(g(Z), 0), Z.min(0))
    same(reduction.argmin(g(Z), 0), Z.argmin(0))
    same(reduction.count_zero(elementwise.tocoo(g(SPARSE)), 0), (SPARSE == 0).sum(0))
    same(reduction.count_nonzero(g(INTS), 1), (INTS != 0).sum(1))
    same(reduction.norm(a, 1), np.abs(A).sum(0).max())
    same(reduction.norm(a), np.sqrt((A * A).sum()))
    for axis in (None, 0, 1):
        same(reduction.normalize(a, axis), A / A.sum(axis=axis, keepdims=axis is not None))
    same(reduction.bincount(g(np.array([0, 1, 1, 4])), minlength=7), np.bincount([0, 1, 1, 4], minlength=7))
    same(reduction.bincount(g(np.array([0, 1, 1, 4])), g(np.array([0.5, 1, 2, 3]))), np.bincount([0, 1, 1, 4], [0.5, 1, 2, 3]))
    same(reduction.reduce(a, 0, "float64", F.max), A.max(0))
    same(reduction.reduce(a, 1, "float64", lambda v: (v * v).sum(), lambda p, q: p + q), (A * A).sum(1))
    same(reduction.reduce(a, None, "float64", lambda v: v.sum(), lambda p, q: p + q), A.sum())
    with pytest.raises(ValueError):
        a.sum(2)
    with pytest.raises(ValueError):
        reduction.bincount(g(np.array([-1, 2])))


def test_sparse(g):
    s = elementwise.tocoo(g(SPARSE))
    for got, want in [(s + s.T.T, SPARSE * 2), (s * g(A), SPARSE * A), (elementwise.exp(s), np.exp(SPARSE)), (s + 1, SPARSE + 1), (s * s, SPARSE**2), (s @ g(B).T, SPARSE @ B.T), (s[1:4, 2], SPARSE[1:4, 2])]:
        same(got, want)


@pytest.mark.parametrize("index", [(slice(1, 3),), (2,), (slice(None), 3, slice(0, 5, 2)), (-1, slice(None, None, -1)), (None, slice(1, 2)), (1, 2), (Ellipsis, 2), (slice(3, 3),), (1, 2, 3), (slice(-2, None), slice(4, 0, -2))], ids=str)
def test_slices(g, index):
    same(g(CUBE)[index], CUBE[index])


def test_indexing(g):
    a, b, c = g(A), g(B), g(CUBE)
    same(a[a > 0], A[A > 0])
    same(a[np.array([3, -1, 0, 3])], A[[3, -1, 0, 3]])
    same(c.reshape(5, 24), CUBE.reshape(5, 24))
    same(c.reshape((-1,)), CUBE.ravel())
    same(c.T, CUBE.T)
    w = A.copy()
    w[2:5, 1] = 9
    same(indexing.assign(a, (slice(2, 5), 1), 9), w)
    w[1:3] = B[:2]
    same(indexing.assign(indexing.assign(a, (slice(2, 5), 1), 9), slice(1, 3), b[:2]), w)
    w = A.copy()
    w[:, 1:3] = [1, 2]
    same(indexing.assign(a, (slice(None), slice(1, 3)), np.array([1.0, 2])), w)
    same(indexing.concatenate(a, b, 1), np.concatenate([A, B], 1))
    same(indexing.region_map(a, [(slice(0, 2),), (slice(1, 3), 2)], lambda v: v * 0), np.where(np.fromfunction(lambda i, j: (i < 2) | ((i >= 1) & (i < 3) & (j == 2)), A.shape), 0, A))
    same(indexing.write(a, slice(0, 2), b[:2], None, lambda p, q: p + q), np.concatenate([A[:2] + B[:2], A[2:]]))
    same(indexing.retile(a, (2, 5)), A)
    for bad in (lambda: a[9], lambda: a[0, 0, 0]):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: a.reshape(4, 4), lambda: indexing.concatenate(a, c)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        a[0] = 1


def test_order(g):
    a, c = g(A), g(CUBE)
    for axis in (0, 1, 2, -1):
        same(sorting.sort(c, axis), np.sort(CUBE, axis))
        same(sorting.argsort(c, axis), np.argsort(CUBE, axis, kind="stable"))
    same(sorting.sort(c, None), np.sort(CUBE, None))
    same(sorting.topk(a, 2), np.argsort(-A, 1, kind="stable")[:, :2])
    for axis in (None, 0, 1):
        want = np.cumsum(A, axis)
        same(sorting.scan(a, axis=axis), want.reshape(A.shape))
        same(sorting.scan(a, np.max, np.maximum.accumulate, axis), np.maximum.accumulate(A.ravel() if axis is None else A, axis or 0).reshape(A.shape))


def test_long_lanes(g, monkeypatch):
    """Lanes over the limit are parted; equal values in great number are parted by their places."""
    monkeypatch.setattr(planner, "LANE", 10)
    big, lanes = R.integers(0, 9, 2000).astype(float), R.normal(size=(3, 50))
    x = g(big)
    same(sorting.sort(x, None), np.sort(big))
    same(sorting.argsort(x, 0), np.argsort(big, kind="stable"))
    same(sorting.scan(x), np.cumsum(big))
    same(sorting.scan(x, np.min, np.minimum.accumulate), np.minimum.accumulate(big))
    same(x[x > 4], big[big > 4])
    same(sorting.sort(g(lanes), 1), np.sort(lanes, 1))
    same(sorting.scan(g(lanes), axis=1), np.cumsum(lanes, 1))


def test_products(g, monkeypatch):
    a, b = g(A), g(B)
    for got, want in [(a @ b.T, A @ B.T), (a @ b[0], A @ B[0]), (a[:, 0] @ b, A[:, 0] @ B), (a[0] @ b[1], np.array([A[0] @ B[1]])), (a @ B.T, A @ B.T), (linalg.outer(a[0], b[1], lambda x, y: x * y), np.outer(A[0], B[1])), (linalg.outer(a, b, lambda x, y: (x - y) * (x - y)), ((A[:, None] - B[None]) ** 2).sum(2)), (linalg.gram(linalg.rows(a), ["x"], [5]), A.T @ A)]:
        same(got, want)
    p, q = R.normal(size=(70, 45)), R.normal(size=(45, 33))
    for limit in (64, 1):
        monkeypatch.setattr(planner, "BLOCKS_A_TASK", limit)
        same(linalg._block_dot(g(p), g(q), "float64", 16), p @ q)
    with pytest.raises(ValueError):
        a @ b


def test_user_functions(g):
    a, b = g(A), g(B)
    same(kernels.map([a, b], lambda x, y: x * y + 1), A * B + 1)
    same(kernels.map([a, b], np.hypot, vectorized=True), np.hypot(A, B))
    same(kernels.map_with_location(a, lambda x, i, j: x + i * 10 + j), A + np.fromfunction(lambda i, j: i * 10 + j, A.shape))
    same(kernels.map2([a, b], (0, 0), lambda ca, va, cb, vb: ([ca[1], cb[1]], va * vb), (5, 5)), A.T @ B)
    same(kernels.shuffle(a, lambda i, j, v: ([j % 2], v), (2,)), [A[:, ::2].sum(), A[:, 1::2].sum()])
    same(kernels.map_tiles(a, (3, 2), lambda t, first: t * 2), A * 2)
    same([r.value for r in kernels.tile_operation(a, (4, 5), lambda t, first: t.sum()).orderBy("t0").collect()], [A[:4].sum(), A[4:].sum()])


def test_images():
    im, f = R.normal(size=(2, 3, 6, 5)), R.normal(size=(4, 3, 2, 3))
    for stride in (1, 2):
        pad = np.zeros((2, 3, 8, 8))
        pad[:, :, :6, :5] = im
        want = np.zeros((2, 4, -(-6 // stride), -(-5 // stride)))
        for x in range(want.shape[2]):
            for y in range(want.shape[3]):
                want[:, :, x, y] = np.einsum("ncij,fcij->nf", pad[:, :, x * stride : x * stride + 2, y * stride : y * stride + 3], f)
        same(image.stencil(im, f, stride), want)
    for p, s in ((2, 2), (3, 2), (3, 1)):
        want = np.array([[[[im[n, c, x * s : x * s + p, y * s : y * s + p].max() for y in range(-(-5 // s))] for x in range(-(-6 // s))] for c in range(3)] for n in range(2)])
        same(image.maxpool(im, p, s), want)


def test_creation(g):
    for got, want in [(creation.eye(4, 6, 1), np.eye(4, 6, 1)), (creation.arange(1, 10, 2.5), np.arange(1, 10, 2.5)), (creation.arange(5), np.arange(5)), (creation.arange((3, 4)), np.arange(12).reshape(3, 4)), (creation.full((2, 3), 7), np.full((2, 3), 7)), (creation.diag(creation.diag(g(A)[0])), A[0]), (creation.diag(g(A)), A.diagonal()), (creation.sparse_diagonal((3, 5)), np.eye(3, 5)), (creation.zeros(3), np.zeros(3))]:
        same(got, want)
    x, n = creation.rand(50, 40, seed=3).glom(), creation.randn(50, 40, seed=3).glom()
    assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.05 and abs(n.mean()) < 0.1 and abs(n.std() - 1) < 0.1
    same(creation.rand(50, 40, seed=3), x)
    assert set(np.unique(creation.randint(500, low=2, high=5).glom())) == {2, 3, 4}
    assert 50 < np.count_nonzero(creation.sparse_rand((100, 100), 0.01).glom()) <= 100
    with pytest.raises(ValueError):
        creation.arange()


def test_files(g, spark, tmp_path):
    path = str(tmp_path)
    arrays.save(g(A), "x", path, tile=(3,))
    same(arrays.load("x", path), A)
    box = np.fromfunction(lambda i, j: (i < 2) & (j >= 1) & (j < 3), A.shape)
    same(arrays.partial_load([((0, 2), (1, 3))], "x", path), np.where(box, A, 0))
    big = "%%MatrixMarket matrix coordinate real general\n4 5 3\n4 5 3\n4 5 0.1\n1 1 1e-17\n"
    (tmp_path / "n.mtx").write_text(big)
    got = {(r.i0, r.i1): r.v for r in arrays.from_file_parallel(str(tmp_path / "n.mtx"), "mm").df.collect()}
    assert got == {(3, 4): 3.1, (0, 0): 1e-17}  # an entry written like the size line counts
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n4 5 4\n1 1 2.5\n4 5 1\n1 1 1\n2 3 -1\n")
    m = np.zeros((4, 5))
    m[0, 0], m[3, 4], m[1, 2] = 3.5, 1, -1
    same(arrays.from_file(f"{path}/m.mtx", "mm"), m)
    np.save(tmp_path / "q.npy", A)
    same(arrays.from_file(f"{path}/q.npy"), A)
    for k, v in (("row", [0, 3, 0]), ("col", [1, 2, 1]), ("data", [1.0, 2, 3]), ("shape", [4, 4])):
        np.save(tmp_path / f"q_{k}.npy", np.array(v))
    q = np.zeros((4, 4))
    q[0, 1], q[3, 2] = 4, 2
    same(arrays.from_file(f"{path}/q"), q)
    same(arrays.from_file_parallel(f"{path}/q", "numpy"), q)
    same(arrays.checkpoint(g(A) + 1) * 2, (A + 1) * 2)


def test_api(g, spark):
    a = g(A)
    assert (a.shape, a.ndim, a.size, a.dtype, len(a)) == ((7, 5), 2, 35, "float64", 7) and as_array(a) is a and issubclass(NotShapeable, Exception)
    assert bool((a == a).all()) and a.optimized() is a
    with pytest.raises(ValueError):
        bool(a > 0)
    same(a.evaluate() + 1, A + 1)
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0)], "r long, c long, x double")
    same(from_table(df, ["r", "c"], "x", sparse=True), [[0, 5.0], [0, 0], [1.0, 0]])


def test_plans(spark, g):
    """Maps over one relation fuse into a projection without a join or a shuffle; slices reach the scan."""
    t = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    x = from_table(t, ["o_orderkey"], "o_totalprice", shape=(1500,))
    plan = ((x * 2 + 1) / (x + 3))[10:20].frame()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_combining_writes_custom_scans_and_single_runs(spark):
    place = gl.ndarray((4,), np.float64, reduce_fn=lambda a, b: a + b)
    once = gl.write(place, slice(0, 3), np.ones(3))
    same(gl.write(once, slice(1, 4), np.full(3, 2.0)), np.array([1.0, 3.0, 3.0, 2.0]))
    bits = np.array([1, 2, 4, 1, 8])
    same(gl.scan(gl.from_numpy(bits), scan_fn=(F.bit_or, lambda a, b: a.bitwiseOR(b))), np.bitwise_or.accumulate(bits))
    runs = []

    @gl.not_idempotent
    def noisy():
        runs.append(1)
        return gl.map([gl.from_numpy(np.arange(5.0))], lambda v: v + F.rand())

    x = noisy()
    same(x, x.glom())
    assert len(runs) == 1


def test_lag_of_keys_with_gaps(spark):
    """Elements before one another are neighbours by order, whatever their keys."""
    from gridloom.algorithms import simulation

    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (5, 4.0), (6, 4.1), (9, 1.0)], "k long, v double")
    got = simulation.find_change(from_table(df, ["k"], "v"), 0.5).frame().collect()
    assert sorted((r.i0, round(r.v, 6)) for r in got) == [(0, 1.0), (4, 1.0), (8, round(-3.1 / 4.1, 6))]


def test_long_lanes_with_unknown_values(spark, monkeypatch):
    """Null comes first, as in short lanes."""
    monkeypatch.setattr(planner, "LANE", 4)
    df = spark.createDataFrame([(k, None if k % 7 == 0 else float(k * 37 % 11)) for k in range(60)], "k long, v double")
    got = sorting.argsort(from_table(df, ["k"], "v")).frame().orderBy("i0").collect()
    assert [r.v for r in got] == sorted(range(60), key=lambda k: (k % 7 != 0, k * 37 % 11 if k % 7 else 0, k))


def test_parts_of_bounds(spark):
    """A row meets 32 bounds at most, and its part is that of all of them."""
    bounds, values = [float(b) for b in range(0, 510, 2)], [float(v) for v in range(-3, 520)]
    df = sorting._parted(spark.createDataFrame([(v,) for v in values], "v double"), "v", bounds)
    got = {r.v: r["__part"] for r in df.collect()}
    assert got == {v: 2 * sum(b < v for b in bounds) + (v in bounds) for v in values}


def test_products_of_a_long_inner_axis(g, monkeypatch):
    """Elements go to the tasks by slices of the inner axis: blocks neither meet in a join nor gather in one task."""
    from gridloom.algorithms import decomposition

    monkeypatch.setattr(planner, "JOIN_PRODUCTS", 1)
    a, b = R.normal(size=(6, 1300)), R.normal(size=(1300, 5))
    out = linalg.dot(g(a), g(b))
    same(out, a @ b)
    assert "Join" not in out.df._jdf.queryExecution().executedPlan().toString()
    counted, real = [], decomposition.kept
    monkeypatch.setattr(decomposition, "kept", lambda df: counted.append(df) or real(df))
    m = a @ a.T / 1300 + np.eye(6) * 10
    x = linalg.dot(g(a), g(a.T)) / 1300.0 + creation.eye(6, dtype="float64") * 10.0
    assert np.allclose(decomposition.conjugate_gradient(x, np.arange(6.0), 9), np.linalg.solve(m, np.arange(6.0)), atol=1e-5)
    assert np.allclose(decomposition.jacobi(x, np.arange(6.0), 20), np.linalg.solve(m, np.arange(6.0)), atol=1e-5)
    assert len(counted) == 2


def test_custom_reduction_in_runs(spark):
    """Lanes split over batches and tasks, in no order, without a group of pandas for each."""
    df = spark.range(600).select((F.col("id") % 7).alias("i"), F.call_function("div", F.col("id"), F.lit(7)).alias("k"), F.col("id").cast("int").alias("v")).where("i < 7").repartition(5)
    x = from_table(df, ["i", "k"], "v", (7, 86))
    out = reduction.reduce(x, 1, "int32", lambda v: int(v.max()), max)
    assert sorted(map(tuple, out.frame().collect())) == [(i, max(range(i, 600, 7))) for i in range(7)]
    assert "FlatMapGroups" not in out.df._jdf.queryExecution().executedPlan().toString()
    assert int(reduction.reduce(x, None, "int64", lambda v: int(v.sum()), lambda a, b: a + b).glom()) == sum(range(600))
