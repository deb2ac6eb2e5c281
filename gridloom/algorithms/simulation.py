"""Graphs, finance and physics."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import GridArray
from ..functions import numeric
from ..operators import elementwise, indexing, sorting


def pagerank(links: DataFrame, pages: int, iterations: int = 5, damping: float | None = None) -> DataFrame:
    """(i0, v) from links (source, target, weight): products of the weights with the ranks; with damping, links of a source share its rank and lost rank is spread."""
    from ..session import kept

    spark = links.sparkSession
    rank = spark.range(pages).select(F.col("id").alias("i0"), F.lit(1.0 / pages).alias("v"))
    if damping is not None:
        total = links.groupBy("source").agg(F.sum("weight").alias("t"))
        links = links.join(total, "source").select("source", "target", (F.col("weight") / F.col("t")).alias("weight"))
    links = kept(links)
    for _ in range(iterations):
        moved = links.join(rank.withColumnRenamed("i0", "source"), "source").groupBy(F.col("target").alias("i0")).agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
        if damping is not None:
            lost = 1.0 - damping * (moved.agg(F.sum("v")).first()[0] or 0.0)
            moved = moved.select("i0", (F.col("v") * damping).alias("v"))
            moved = spark.range(pages).withColumnRenamed("id", "i0").join(moved, "i0", "left").select("i0", (F.coalesce("v", F.lit(0.0)) + lost / pages).alias("v"))
        rank = kept(moved)
    return rank


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int = 100) -> DataFrame:
    """(source, node, distance) from edges (a, b, w) and sources (source): relaxation by joins until nothing gets shorter."""
    from ..session import kept

    both = kept(edges.select("a", "b", "w").union(edges.select("b", "a", "w")))
    best = kept(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance")))
    moving = best
    for _ in range(rounds):
        reached = moving.join(both, moving["node"] == both["a"]).groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        merged = kept(reached.join(best, ["source", "node"], "full").select("source", "node", F.least("distance", "new").alias("distance"), (F.col("distance").isNull() | (F.col("new") < F.col("distance"))).alias("shorter")))
        best, moving = merged.drop("shorter"), merged.where("shorter").drop("shorter")
        if moving.isEmpty():
            break
    return best


def isomap(rows: DataFrame, n: int, k: int, dimensions: int) -> np.ndarray:
    """Coordinates that keep distances along the graph of nearest neighbours; for up to 4096 rows, whose distance matrix the driver decomposes."""
    from .learning import knn

    if n > 4096:
        raise ValueError("isomap decomposes a matrix of up to 4096 rows on the driver")
    near = knn(rows, rows, k + 1).where("query <> i0")
    edges = near.select(F.least("query", "i0").alias("a"), F.greatest("query", "i0").alias("b"), F.col("distance").alias("w")).distinct()
    table = shortest_paths(edges, rows.select(F.col("i0").alias("source")), n).toArrow()
    d = np.full((n, n), np.nan)
    d[table.column("source").to_numpy(), table.column("node").to_numpy()] = table.column("distance").to_numpy()
    d = np.where(np.isnan(d), np.nanmax(d), d)
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    order = np.argsort(-values)[:dimensions]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def black_scholes(current: Column, strike: Column, maturity: Column, rate: float, volatility: float) -> tuple[Column, Column]:
    """Prices of calls and puts."""
    root = volatility * F.sqrt(maturity)
    d1 = (numeric.log(current / strike) + (rate + 0.5 * volatility * volatility) * maturity) / root
    d2 = d1 - root
    discounted = strike * F.exp(-rate * maturity)
    call = current * numeric.norm_cdf(d1) - discounted * numeric.norm_cdf(d2)
    put = discounted * numeric.norm_cdf(-d2) - current * numeric.norm_cdf(-d1)
    return call, put


def find_change(prices: GridArray, threshold: float) -> GridArray:
    """The relative changes from one element to the next that exceed the threshold, at their places."""
    now, before = sorting.lag(prices)
    change = elementwise.true_divide(now - before, before)
    return indexing.masked(change, elementwise.greater(elementwise.abs(change), threshold))


def predict_price(prices: GridArray, lag: int = 5) -> tuple[float, float]:
    """Slope and intercept of the regression of a price on the one so many elements before."""
    now, before = sorting.lag(prices, lag)
    r = now.df.agg(F.regr_slope(now.value, before.value), F.regr_intercept(now.value, before.value)).first()
    return r[0], r[1]


def pearson(x: GridArray, y: GridArray) -> float:
    a, b = elementwise.joined(x, y)
    return a.df.agg(F.corr(a.value, b.value)).first()[0]


#: Bodies that are sent to the tasks at once, and of these those that a task takes at once.
SENT, TILE = 1 << 17, 1 << 9


def pulls(bodies: DataFrame, own: DataFrame, low: int | None, high: int | None, softening: float) -> DataFrame:
    """(i0, ax, ay, az, n): what the bodies numbered from low to below high pull on each of own, and how many others they are."""
    spark, sides = bodies.sparkSession, ["i0", "m", "x", "y", "z"]
    others = bodies.where(" and ".join(f"{c} is not null" for c in sides))
    if low is not None:
        others = others.where((F.col("i0") >= low) & (F.col("i0") < high))
    table = others.select("i0", *[F.col(c).cast("double").alias(c) for c in sides[1:]]).toArrow()
    sent = spark.sparkContext.broadcast([table.column(c).to_numpy() for c in sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, m, *there = sent.value
        for batch in batches:
            i, here = batch.column(0).to_numpy(), [batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)]
            out, n = np.zeros((3, len(i))), np.zeros(len(i), np.int64)
            for lo, at in itertools.product(range(0, len(i), TILE), range(0, len(j), TILE)):
                d = [t[None, at : at + TILE] - h[lo : lo + TILE, None] for t, h in zip(there, here, strict=True)]
                r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + softening
                same = i[lo : lo + TILE, None] == j[None, at : at + TILE] if max(i[lo : lo + TILE].min(), j[at : at + TILE].min()) <= min(i[lo : lo + TILE].max(), j[at : at + TILE].max()) else None
                with np.errstate(divide="ignore", invalid="ignore"):
                    pull = m[None, at : at + TILE] / (r2 * np.sqrt(r2))
                if same is not None:
                    pull[same] = 0.0
                    for c in d:
                        c[same] = 0.0
                n[lo : lo + TILE] += pull.shape[1] - (same.sum(1) if same is not None else 0)
                for c in range(3):
                    out[c, lo : lo + TILE] += np.einsum("ij,ij->i", d[c], pull)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(a) for a in out), pa.array(n)], names=["i0", "ax", "ay", "az", "n"])

    return own.select("i0", *[F.col(c).cast("double").alias(c) for c in "xyz"]).mapInArrow(run, "i0 long, ax double, ay double, az double, n long")


def nbody(bodies: DataFrame, steps: int = 1, dt: float = 0.01, softening: float = 1e-3) -> DataFrame:
    """(i0, m, x, y, z, vx, vy, vz) after so many steps. Every body pulls every other one, which is the method: SENT bodies at a time go to the tasks that hold the others, whose sums are all that is stored."""
    from ..session import kept

    tasks = 4 * bodies.sparkSession.sparkContext.defaultParallelism
    for _ in range(steps):
        bodies = kept(bodies.withColumn("i0", F.col("i0").cast("long")))
        count = bodies.count()
        groups, edges = -(-count // SENT), []
        if groups > 1:
            edges = sorted(set(bodies.agg(F.percentile_approx("i0", [k / groups for k in range(1, groups)], 20 * groups)).first()[0]))
            span = bodies.agg(F.min("i0"), F.max("i0")).first()
            edges = [span[0], *[e for e in edges if e > span[0]], span[1] + 1]
        own = bodies.repartition(tasks)
        found = None
        for low, high in zip(edges[:-1], edges[1:], strict=True) if edges else [(None, None)]:
            part = kept(pulls(bodies, own, low, high, softening))
            found = part if found is None else found.union(part)
        force = found.groupBy("i0").agg(*[F.sum(f"a{c}").alias(f"a{c}") for c in "xyz"], F.sum("n").alias("n")).where("n > 0")
        moved = bodies.join(force, "i0").select("i0", "m", *[F.col(c) for c in "xyz"], *[(F.col(f"v{c}") + dt * F.col(f"a{c}")).alias(f"v{c}") for c in "xyz"])
        bodies = kept(moved.select("i0", "m", *[(F.col(c) + dt * F.col(f"v{c}")).alias(c) for c in "xyz"], "vx", "vy", "vz"))
    return bodies


def swaption(spark, paths: int, rates: list[float], strike: float, volatility: float, delta: float = 0.5, start: int = 1, seed: int = 1) -> tuple[float, float]:
    """Price of a payer swaption in the lognormal forward-rate model by simulation, and its standard error. A path is a row; its draws depend on its number only, so lost tasks repeat them."""
    n = len(rates)
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(k), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    df = spark.range(paths)
    columns = [F.lit(float(r)) for r in rates]
    df = df.select("id", *[c.alias(f"l{k}") for k, c in enumerate(columns)])
    discount = F.lit(1.0)
    df = df.withColumn("discount", discount)
    for t in range(start):
        z = F.sqrt(-2 * F.ln(u(2 * t))) * F.cos(2 * np.pi * u(2 * t + 1))
        new, drift = [], F.lit(0.0)
        for k in range(t + 1, n):
            drift = drift + delta * F.col(f"l{k}") * volatility**2 / (1 + delta * F.col(f"l{k}"))
            new.append((k, F.col(f"l{k}") * F.exp((drift - 0.5 * volatility**2) * delta + volatility * delta**0.5 * F.col("z"))))
        df = df.withColumn("z", z).select("id", (F.col("discount") / (1 + delta * F.col(f"l{t}"))).alias("discount"), *[F.col(f"l{k}") for k in range(t + 1)], *[c.alias(f"l{k}") for k, c in new])
    bond, value = F.lit(1.0), F.lit(0.0)
    for k in range(start, n):
        bond = bond / (1 + delta * F.col(f"l{k}"))
        value = value + bond * delta * (F.col(f"l{k}") - strike)
    r = df.select((F.greatest(value, F.lit(0.0)) * F.col("discount")).alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
    return r[0], r[1] / paths**0.5


