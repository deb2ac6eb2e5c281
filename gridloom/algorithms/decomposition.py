"""Eigenvectors, singular values and factorisations: products over the data, small matrices on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import GridArray
from ..operators import linalg
from ..session import kept
from .clustering import summed

#: Longest vector that iterations keep on the driver (128 MB).
VECTOR = 1 << 24


def matvec(a: GridArray, x: np.ndarray, transposed: bool = False) -> np.ndarray:
    """a x or aᵀ x, x and the result being vectors of the driver's."""
    if max(a.shape) > VECTOR:
        raise ValueError(f"vectors of the driver's hold up to {VECTOR} elements")
    i, k = (1, 0) if transposed else (0, 1)
    vector = a.spark.createDataFrame(pa.table({"k": pa.array(np.arange(len(x))), "x": pa.array(np.asarray(x, np.float64))}))
    cells = a.frame().select(F.col(f"i{i}").alias("i"), F.col(f"i{k}").alias("k"), "v").join(F.broadcast(vector) if len(x) <= 1 << 20 else vector, "k")
    table = cells.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y")).toArrow()
    out = np.zeros(a.shape[i])
    out[table.column("i").to_numpy()] = table.column("y").to_numpy()
    return out


def settled(a: GridArray) -> GridArray:
    """a written out, so that the products of an iteration don't compute it anew."""
    return GridArray(kept(a.frame()), a.shape, a.dtype, "v", a.sparse)


def lanczos(a, rank: int, extra: int = 8, symmetric: bool = True, seed: int = 1, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues and eigenvectors of a, or of aᵀa if not symmetric; with full re-orthogonalisation. a: an array, or a function that gives a symmetric matrix times a vector of n elements."""
    n = a.shape[1] if n is None else n
    steps = min(n, rank + max(extra, rank))
    q = np.random.default_rng(seed).normal(size=n)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(steps):
        w = a(basis[-1]) if callable(a) else matvec(a, basis[-1]) if symmetric else matvec(a, matvec(a, basis[-1]), True)
        alpha.append(float(w @ basis[-1]))
        known = np.array(basis)
        for _ in range(2):
            w = w - known.T @ (known @ w)
        size = float(np.linalg.norm(w))
        if size < 1e-10 or len(basis) == steps:
            break
        beta.append(size)
        basis.append(w / size)
    m = len(alpha)
    t = np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1)
    values, vectors = np.linalg.eigh(t)
    order = np.argsort(-values)[:rank]
    return values[order], np.array(basis[:m]).T @ vectors[:, order]


def svds(a: GridArray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s, vᵀ of the leading singular values."""
    values, v = lanczos(a, rank, symmetric=False)
    s = np.sqrt(np.maximum(values, 0))
    u = np.array([matvec(a, v[:, k]) / max(s[k], 1e-300) for k in range(len(s))]).T
    return u, s, v.T


def pca(vectors: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows) and explained variances of (i0, x), in one pass."""
    g = linalg.gram(vectors.withColumn("one", F.lit(1.0)), ["x", "one"], [width, 1])
    n = g[-1, -1]
    mean = g[-1, :-1] / n
    values, axes = np.linalg.eigh((g[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(-values)[:k]
    return mean, axes[:, order].T, values[order]


def project(vectors: DataFrame, matrix: np.ndarray, column: str = "x") -> DataFrame:
    """(i0, x) with x @ matrix for x; the matrix is small and goes to every task."""
    if matrix.size > 1 << 22:
        raise ValueError("the matrix of a projection is up to 32 MB")

    def run(batches):
        for batch in batches:
            y = linalg.stacked(batch.column(1), matrix.shape[0]) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y.tolist(), pa.list_(pa.float64()))], names=["i0", "x"])

    return vectors.select("i0", column).mapInArrow(run, "i0 long, x array<double>")


def qr(vectors: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """Thin QR of (i0, x): R by Cholesky of the Gram matrix, Q = X R⁻¹, twice for orthogonality."""
    r = np.eye(width)
    q = vectors
    for _ in range(2):
        step = np.linalg.cholesky(linalg.gram(q, ["x"], [width])).T
        q, r = project(q, np.linalg.inv(step)), step @ r
    return q, r


def ssvd(vectors: DataFrame, width: int, rank: int, oversample: int = 8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors by a random projection: Y = X Ω, an orthonormal Q of Y, and the small B = Qᵀ X."""
    k = min(width, rank + oversample)
    omega = np.random.default_rng(seed).normal(size=(width, k))
    q, _ = qr(project(vectors, omega).persist(), k)
    both = q.withColumnRenamed("x", "q").join(vectors, "i0")
    b = summed(both, ["q", "x"], (k, width), lambda y, x: y.T @ x)
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    return s[:rank], vt[:rank]


def cholesky(a: GridArray, size: int = 256) -> GridArray:
    """The lower factor of a positive definite matrix by blocks: for each block column, its diagonal block is factored, the blocks below are solved for, and the rest is updated by a join; written out at each step."""
    n = a.shape[0]
    if a.shape != (n, n):
        raise ValueError("a square matrix is asked for")
    spark = a.spark
    work = linalg.blocks(a.dense(), size).where("b0 >= b1")
    work = kept(work)
    done: list[DataFrame] = []
    for k in range(-(-n // size)):
        wide = min(size, n - k * size)
        diagonal = np.linalg.cholesky(np.frombuffer(work.where((F.col("b0") == k) & (F.col("b1") == k)).first().data).reshape(wide, wide))
        inverse = np.linalg.inv(diagonal).T

        def solve(batches, inv=inverse, w=wide):
            for batch in batches:
                out = [(np.frombuffer(d).reshape(-1, w) @ inv).tobytes() for d in batch.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("b0"), batch.column("b1"), pa.array(out, pa.binary())], names=["b0", "b1", "data"])

        column = work.where((F.col("b1") == k) & (F.col("b0") > k)).mapInArrow(solve, "b0 long, b1 long, data binary")
        column = kept(column)
        done += [spark.createDataFrame([(k, k, bytearray(diagonal.tobytes()))], "b0 long, b1 long, data binary"), column]
        left, right = column.select("b0", F.col("data").alias("l")), column.select(F.col("b0").alias("b1"), F.col("data").alias("r"))

        def update(batches, w=wide):
            for batch in batches:
                out = []
                for d, x, y in zip(*(batch.column(c).to_pylist() for c in ("data", "l", "r")), strict=True):
                    product = np.frombuffer(x).reshape(-1, w) @ np.frombuffer(y).reshape(-1, w).T
                    out.append((np.frombuffer(d).reshape(product.shape) - product).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("b0"), batch.column("b1"), pa.array(out, pa.binary())], names=["b0", "b1", "data"])

        rest = work.where(F.col("b1") > k).join(left, "b0").join(right, "b1").select("b0", "b1", "data", "l", "r")
        work = kept(rest.mapInArrow(update, "b0 long, b1 long, data binary"))
    total = done[0]
    for d in done[1:]:
        total = total.unionByName(d)
    return GridArray(linalg.unblocked(total, n, n, size).where("i0 >= i1"), (n, n), "float64", "v", True)


def jacobi(a: GridArray, b: np.ndarray, iterations: int = 50) -> np.ndarray:
    """x of a x = b for a diagonally dominant a."""
    a = settled(a)
    table = a.frame().where("i0 = i1").select("i0", "v").toArrow()
    diagonal = np.zeros(a.shape[0])
    diagonal[table.column("i0").to_numpy()] = table.column("v").to_numpy()
    x = np.zeros_like(diagonal)
    for _ in range(iterations):
        x = (b - (matvec(a, x) - diagonal * x)) / diagonal
    return x


def conjugate_gradient(a: GridArray, b: np.ndarray, iterations: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """x of a x = b for a symmetric positive definite a."""
    a = settled(a)
    x = np.zeros(a.shape[0])
    r = b - matvec(a, x)
    p, rr = r.copy(), float(r @ r)
    for _ in range(iterations):
        if rr <= tolerance:
            break
        ap = matvec(a, p)
        step = rr / float(p @ ap)
        x, r = x + step * p, r - step * ap
        new = float(r @ r)
        p, rr = r + new / rr * p, new
    return x
