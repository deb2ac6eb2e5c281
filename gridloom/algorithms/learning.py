"""Regression, classification, recommendation and topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import linalg
from ..session import kept
from .clustering import distances, summed


# regression: rows (x vector, y)


def gradient_descent(rows: DataFrame, width: int, gradient, alpha: float = 1e-6, iterations: int = 10, start: np.ndarray | None = None) -> np.ndarray:
    """Full-batch steps: gradient(x, y, w) of a batch, summed over all of them."""
    w = np.zeros(width) if start is None else start.astype(float)
    for _ in range(iterations):
        w = w - alpha * summed(rows, ["x", "y"], (1, width), lambda x, y, now=w: gradient(x, y, now)[None])[0]
    return w


def linear_gradient(x, y, w):
    return x.T @ (x @ w - y)


def logistic_gradient(x, y, w):
    return x.T @ (1.0 / (1.0 + np.exp(-(x @ w))) - y)


def linear_regression(rows, width, alpha=1e-6, iterations=10, start=None):
    return gradient_descent(rows, width, linear_gradient, alpha, iterations, start)


def logistic_regression(rows, width, alpha=1e-6, iterations=10, start=None):
    return gradient_descent(rows, width, logistic_gradient, alpha, iterations, start)


def ridge_regression(rows, width, penalty=1.0, alpha=1e-6, iterations=10, start=None):
    """Minus the gradient of half the squared error plus half the penalised squared weights; the penalty counts once."""
    w = np.zeros(width) if start is None else start.astype(float)
    for _ in range(iterations):
        w = w - alpha * (summed(rows, ["x", "y"], (1, width), lambda x, y, now=w: linear_gradient(x, y, now)[None])[0] + penalty * w)
    return w


def least_squares(rows: DataFrame, width: int, penalty: float = 0.0, intercept: bool = True) -> tuple[np.ndarray, float]:
    """Weights and intercept from the normal equations, in one pass."""
    g = linalg.gram(rows.withColumn("one", F.lit(1.0)), ["x", "y", "one"], [width, 1, 1])
    n = g[-1, -1]
    mean = g[-1, :-1] / n if intercept else np.zeros(width + 1)
    centred = g[:-1, :-1] - n * np.outer(mean, mean)
    w = np.linalg.solve(centred[:-1, :-1] + penalty * np.eye(width), centred[:-1, -1])
    return w, float(mean[-1] - mean[:-1] @ w)


# classification


def naive_bayes(counts: DataFrame, documents: int, alpha: float = 1.0) -> DataFrame:
    """(label, term, weight) from (doc, term, n, label): idf = ln(N / (df + 1)) + 1, rows of tf * idf over their root mean square, summed by label, and the log of smoothed shares."""
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    tfidf = counts.join(frequency, "term").withColumn("v", F.col("n") * (F.ln(F.lit(float(documents)) / (F.col("df") + 1)) + 1))
    scale = tfidf.groupBy("doc").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("r"))
    by_label = tfidf.join(scale, "doc").groupBy("label", "term").agg(F.sum(F.col("v") / F.col("r")).alias("w"))
    terms = counts.select("term").distinct()
    grid = terms.crossJoin(F.broadcast(counts.select("label").distinct()))  # labels are few
    smoothed = grid.join(by_label, ["label", "term"], "left").select("label", "term", (F.coalesce("w", F.lit(0.0)) + alpha).alias("w"))
    total = smoothed.groupBy("label").agg(F.sum("w").alias("t"))
    return smoothed.join(F.broadcast(total), "label").select("label", "term", F.ln(F.col("w") / F.col("t")).alias("weight"))


def naive_bayes_predict(model: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, label): the label of the largest score, of equal ones the least."""
    scores = counts.join(model, "term").groupBy("doc", model["label"]).agg(F.round(F.sum(F.col("n") * F.col("weight")), 9).alias("s"))
    return scores.groupBy("doc").agg(F.min_by("label", F.struct((-F.col("s")).alias("s"), "label")).alias("label"))


def svm_dual(rows: DataFrame, width: int, penalty: float = 1e-2, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """A linear support vector machine by distributed dual coordinate ascent. Every row (x, y = ±1) has a dual variable in [0, 1]. In a round each task ascends over its own rows from the common weights; a share of one over the number of tasks of every change is kept, and the weights are summed anew from all dual variables."""
    own = kept(rows.select("x", F.col("y").cast("double").alias("y"), F.lit(0.0).alias("a")))
    n = own.count()
    w = np.zeros(width)
    if not n:
        return w
    for turn in range(rounds):
        tasks = own.rdd.getNumPartitions()

        def run(batches: Iterator[pa.RecordBatch], start=w, step=turn, share=1.0 / max(tasks, 1)) -> Iterator[pa.RecordBatch]:
            rng, local = np.random.default_rng(seed + step), start.copy()
            for batch in batches:
                x, y, old = linalg.stacked(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                a = old.copy()
                for i in rng.permutation(len(y)):
                    size = float(x[i] @ x[i])
                    if size:
                        new = min(1.0, max(0.0, a[i] + penalty * n * (1.0 - y[i] * float(local @ x[i])) / size))
                        local += (new - a[i]) * y[i] * x[i] / (penalty * n)
                        a[i] = new
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(old + share * (a - old))], names=["x", "y", "a"])

        own = kept(own.mapInArrow(run, "x array<double>, y double, a double"))
        w = summed(own, ["x", "y", "a"], (1, width), lambda x, y, a: ((a * y) @ x)[None])[0] / (penalty * n)
    return w


def svm_smo(x: np.ndarray, y: np.ndarray, c: float = 1.0, tolerance: float = 1e-3, sweeps: int = 100, kernel=None) -> tuple[np.ndarray, float]:
    """Sequential minimal optimisation with the pair that violates most, for samples that fit on the driver (20000 rows at most): dual variables and offset."""
    if len(x) > 20_000:
        raise ValueError("SMO keeps a kernel matrix: use svm_dual for more than 20000 rows")
    k = x @ x.T if kernel is None else kernel(x, x)
    alpha, gradient = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(sweeps * len(y)):
        score = -y * gradient
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        i, j = int(np.where(up, score, -np.inf).argmax()), int(np.where(low, score, np.inf).argmin())
        if score[i] - score[j] < tolerance:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (score[i] - score[j]) / curve
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        gradient += step * y * (k[:, i] - k[:, j])
    score = -y * gradient
    return alpha, float((score[i] + score[j]) / 2)


def random_forest(rows: DataFrame, label: str, vector: str = "x", trees: int = 50, depth: int = 10, seed: int = 1):
    """A fitted forest of Spark's own: vector is an array column, label a number."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def multilayer(rows: DataFrame, widths: list[int], rounds: int = 20, rate: float = 0.5, seed: int = 1) -> list[np.ndarray]:
    """A perceptron with sigmoid layers and a softmax on top; rows (x, y = class). Full-batch gradients, one aggregation for each round."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(size=(a + 1, b)) / np.sqrt(a + 1) for a, b in zip(widths, widths[1:])]
    sizes = [w.size for w in weights]
    n = rows.count()
    for _ in range(rounds):

        def step(x, y, now=weights):
            layers = [np.concatenate([x, np.ones((len(x), 1))], 1)]
            for w in now[:-1]:
                layers.append(np.concatenate([1 / (1 + np.exp(-(layers[-1] @ w))), np.ones((len(x), 1))], 1))
            p = softmax(layers[-1] @ now[-1])
            p[np.arange(len(y)), y.astype(int)] -= 1
            out, delta = [], p
            for w, own in zip(now[::-1], layers[::-1], strict=True):
                out.append(own.T @ delta)
                delta = ((delta @ w.T) * own * (1 - own))[:, :-1]
            return np.concatenate([g.ravel() for g in out[::-1]])[None]

        flat = summed(rows, ["x", "y"], (1, sum(sizes)), step)[0] / max(n, 1)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        weights = [w - rate * g.reshape(w.shape) for w, g in zip(weights, parts, strict=True)]
    return weights


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def multilayer_predict(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    for w in weights[:-1]:
        x = 1 / (1 + np.exp(-(np.concatenate([x, np.ones((len(x), 1))], 1) @ w)))
    return (np.concatenate([x, np.ones((len(x), 1))], 1) @ weights[-1]).argmax(1)


# neighbours


#: Distances that a task holds at once (8 MB).
CELLS = 1 << 20


def _nearest(best: tuple[np.ndarray, np.ndarray], q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the best so far (squared distances and ids by query) and of the rows x. Products tell which rows may be among them; only of these the exact differences count."""
    own = (x * x).sum(1)
    near = q @ x.T
    near *= -2.0
    near += own
    near += (q * q).sum(1)[:, None]
    slack = 1e-9 * (own.max(initial=0) + (q * q).sum(1).max(initial=0))
    m = min(k, best[0].shape[1] + len(x))
    bound = best[0][:, -1] if best[0].shape[1] >= k else np.full(len(q), np.inf)
    if len(x) > k:
        bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
    # a comparison with NaN is false: such rows stay, and sort last
    row, column = np.nonzero(~(near > (bound + slack)[:, None]))
    difference = x[column] - q[row]
    d = np.einsum("ij,ij->i", difference, difference)
    row = np.concatenate([np.repeat(np.arange(len(q)), best[0].shape[1]), row])
    d, i = np.concatenate([best[0].ravel(), d]), np.concatenate([best[1].ravel(), ids[column]])
    order = np.lexsort((i, d, row))
    row, d, i = row[order], d[order], i[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < m
    return d[first].reshape(len(q), m), i[first].reshape(len(q), m)


def knn(rows: DataFrame, queries: DataFrame, k: int, block: int = 1 << 20) -> DataFrame:
    """(query, rank, i0, distance): the k nearest rows of each query row, of equal ones the least. Queries go to the rows in blocks of so many numbers; each task returns its own k best."""
    width = len(rows.first().x)
    out = None
    held = queries.select("i0", "x").toLocalIterator()
    part: list = []
    limit = max(1, block // width)

    def search(own: list) -> DataFrame:
        ids, q = np.array([r.i0 for r in own]), np.array([r.x for r in own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
            step = max(1, CELLS // len(q))
            for batch in batches:
                ids_of, x = batch.column(0).to_numpy(), linalg.stacked(batch.column(1), width)
                for low in range(0, len(x), step):
                    best = _nearest(best, q, x[low : low + step], ids_of[low : low + step], k)
            m = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(best[1].ravel()), pa.array(np.sqrt(best[0].ravel()))], names=["query", "i0", "distance"])

        return rows.select("i0", "x").mapInArrow(run, "query long, i0 long, distance double")

    for r in held:
        part.append(r)
        if len(part) >= limit:
            out = search(part) if out is None else out.union(search(part))
            part = []
    if part:
        out = search(part) if out is None else out.union(search(part))
    if out is None:
        return rows.sparkSession.createDataFrame([], "query long, rank int, i0 long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "i0")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "i0", "distance")


# recommendation: ratings (user, item, v)


#: Ratings of a block of items that a task of item_similarity holds (64 MB with their places), and the terms that it adds up at once.
HELD, TERMS = 1 << 22, 1 << 20


def item_similarity(ratings: DataFrame, k: int) -> DataFrame:
    """(item, rank, other, similarity): the k items of largest cosine, the item itself among them. A task holds the lists of a block of items by user and gets the other items one by one, each with its ratings by users of the block; what it returns are each item's best of the block, so that pairs of items are neither stored nor shuffled. Where many users rate a large share of all items, the work is quadratic by definition."""
    spark = ratings.sparkSession
    kinds = dict(ratings.dtypes)
    tasks = spark.sparkContext.defaultParallelism
    own = ratings.where("item is not null").repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "item").groupBy("item", F.col("user").cast("long").alias("user")).agg(F.sum("v").cast("double").alias("v"))
    lists = own.where("v is not null").groupBy(F.col("item").cast("long").alias("item")).agg(F.sort_array(F.collect_list(F.struct("user", "v"))).alias("cells"))
    lists = lists.withColumn("r", F.sqrt(F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["v"] * c["v"]))).where("r > 0")
    lists = lists.withColumn("cells", F.filter("cells", lambda c: c["user"].isNotNull()))
    lists = kept(lists.select("item", F.transform("cells", lambda c: c["user"]).alias("users"), F.transform("cells", lambda c: c["v"] / F.col("r")).alias("vs")))
    size = lists.agg(F.sum(F.size("users"))).first()[0] or 0
    blocks = max(-(-size // HELD), min(2 * tasks, size >> 15), 1)  # the last ones so that all cores have work
    edges = []
    if blocks > 1:
        edges = sorted(set(lists.select("item", F.explode("users")).agg(F.percentile_approx("item", [n / blocks for n in range(1, blocks)], 20 * blocks)).first()[0]))
    block = F.lit(0)
    for edge in edges:
        block = block + (F.col("item") > edge).cast("int")
    cells = lists.withColumn("block", block).select("block", "item", F.explode(F.arrays_zip("users", "vs")).alias("c")).select("block", "item", F.col("c.users").alias("user"), F.col("c.vs").alias("v"))
    held = cells.groupBy("block", "user").agg(F.sort_array(F.collect_list(F.struct("item", "v"))).alias("c"))
    held = held.select("block", F.lit(0).alias("asks"), F.col("user").alias("id"), F.transform("c", lambda c: c["item"]).alias("ids"), F.transform("c", lambda c: c["v"]).alias("vs"))
    if edges:
        met = cells.select("item", "user", "v").join(cells.select("block", "user").distinct(), "user").groupBy("block", "item").agg(F.sort_array(F.collect_list(F.struct("user", "v"))).alias("c"))
        met = met.select("block", "item", F.transform("c", lambda c: c["user"]).alias("users"), F.transform("c", lambda c: c["v"]).alias("vs"))
    else:
        met = lists.select(F.lit(0).alias("block"), "item", "users", "vs")
    asking = met.select("block", F.lit(1).alias("asks"), F.col("item").alias("id"), F.col("users").alias("ids"), "vs")
    dealt = held.union(asking).repartition(8 * (len(edges) + 1), "block").sortWithinPartitions("block", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_lists, block = None, [], None
        for batch in batches:
            b, asks, ids = (batch.column(n).to_numpy() for n in range(3))
            edges = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if key != b[lo]:
                    key, held_lists, block = b[lo], [], None
                lists = batch.column(3).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo)
                lengths, flat, values = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()
                if not asks[lo]:
                    held_lists.append((ids[lo:hi], lengths, flat, values))
                    continue
                if block is None:
                    block, held_lists = _Block(held_lists), []
                found = [block.best(flat[at - n : at], values[at - n : at], k) for at, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["item", "other", "similarity"])

    pairs = dealt.mapInArrow(run, "item long, other long, similarity double")
    w = Window.partitionBy("item").orderBy(F.desc(F.round("similarity", 9)), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("item").cast(kinds["item"]).alias("item"), "rank", F.col("other").cast(kinds["item"]).alias("other"), "similarity")


class _Block:
    """The ratings of a block of items by user."""

    def __init__(self, lists: list):
        self.users = np.concatenate([x[0] for x in lists])
        self.lengths = np.concatenate([x[1] for x in lists])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.items, at = np.unique(np.concatenate([x[2] for x in lists]), return_inverse=True)
        self.at, self.values = at.astype(np.int32), np.concatenate([x[3] for x in lists])
        self.positive = bool((self.values > 0).all())

    def best(self, users: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The items that have a user in common with this one, and the products; only those that may be among the k first by products rounded to nine digits, of equal ones by item."""
        row = np.minimum(np.searchsorted(self.users, users), len(self.users) - 1)
        there = self.users[row] == users
        row, values = row[there], values[there]
        positive = self.positive and bool((values > 0).all())
        lengths, low, total, count = self.lengths[row], 0, None, None
        ends = np.cumsum(lengths)
        if not len(row):
            return np.empty(0, np.int64), np.empty(0)
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TERMS, "right")))
            n = lengths[low:high]
            stop = np.cumsum(n)
            place = np.arange(stop[-1]) + np.repeat(self.starts[row[low:high]] - stop + n, n)
            at = self.at[place]
            if low == 0:
                base = 0 if high < len(row) else int(at.min())
            at = at - base if base else at
            wide = len(self.items) - base if high < len(row) or low else int(at.max()) + 1
            own = np.bincount(at, self.values[place] * np.repeat(values[low:high], n), wide)
            total = own if total is None else total + own
            if not positive:
                own = np.bincount(at, minlength=wide)
                count = own if count is None else count + own
            low = high
        met = np.flatnonzero(total > 0 if positive else count > 0)
        s, item = total[met], self.items[met + base]
        # rounding may fall either way next to a half: the most and the least that it gives
        most, least = np.floor(s * 1e9 + 0.5 + 1e-3), np.floor(s * 1e9 + 0.5 - 1e-3)
        if len(s) > k:
            bound = np.partition(least, len(s) - k)[len(s) - k]
            near = most >= bound
            s, item, most, least = s[near], item[near], most[near], least[near]
            order = np.lexsort((item, -least))
            last, lowest = item[order[k - 1]], least[order[k - 1]]
            near = (most > lowest) | ((most == lowest) & (item <= last))
            s, item = s[near], item[near]
        return item, s


def als(ratings: DataFrame, rank: int = 10, penalty: float = 0.1, iterations: int = 5, implicit: bool = False, alpha: float = 1.0, seed: int = 1):
    """Alternating least squares by Spark's own blocks: a fitted model of user and item factors. The penalty is scaled by the number of ratings."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, regParam=penalty, maxIter=iterations, implicitPrefs=implicit, alpha=alpha, userCol="user", itemCol="item", ratingCol="v", seed=seed, coldStartStrategy="drop").fit(ratings.select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("v").cast("float")))


def sgd_factors(ratings: DataFrame, rank: int = 20, rate: float = 0.01, epochs: int = 5, parts: int = 4, penalty: float = 0.02, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """User and item factors by stochastic gradient descent in strata: users and items are dealt into parts, and in each of the strata every task has users and items of its own. (id, x) each."""
    spark = ratings.sparkSession
    start = lambda name: F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda k: (F.pmod(F.xxhash64(F.col(name), k, F.lit(seed)), F.lit(10_000)) / 10_000.0 - 0.3) / float(rank) ** 0.5)
    dealt = ratings.select("user", "item", F.col("v").cast("double").alias("v")).withColumn("a", F.pmod(F.xxhash64("user"), F.lit(parts))).withColumn("b", F.pmod(F.xxhash64("item"), F.lit(parts)))
    dealt = kept(dealt)
    users = kept(dealt.select(F.col("user").alias("id")).distinct().select("id", start("id").alias("x")))
    items = kept(dealt.select(F.col("item").alias("id")).distinct().select("id", start("id").alias("x")))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a task come by part: its items' factors, which are held, then each user's factors before its ratings; a user's are let go when the next one comes."""
        part, known, held, trained = None, [], None, None
        user, p, done = None, None, []

        def packed(side, ids, xs):
            return pa.RecordBatch.from_arrays([pa.array([side] * len(ids)), pa.array(ids, pa.int64()), pa.array(xs, pa.list_(pa.float64()))], names=["side", "id", "x"])

        def items():
            at = np.flatnonzero(trained) if held is not None else np.empty(0, np.int64)
            for low in range(0, len(at), 1 << 14):
                own = at[low : low + (1 << 14)]
                yield packed("m", held[0][own], held[1][own].tolist())

        for batch in batches:
            parts, kinds, us, ms = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            vs, xs = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)
            edges = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | ((kinds[1:] == 0) != (kinds[:-1] == 0))) + 1).tolist(), len(parts)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if part != parts[lo]:
                    if user is not None:
                        done.append((user, p.tolist()))
                    yield from items()
                    part, known, held, trained, user = parts[lo], [], None, None, None
                if kinds[lo] == 0:
                    known.append((ms[lo:hi].astype(np.int64), linalg.stacked(xs.slice(lo, hi - lo), rank).astype(float)))
                    continue
                if held is None:
                    held = np.concatenate([k[0] for k in known]), np.concatenate([k[1] for k in known])
                    order = np.argsort(held[0])
                    held, known = (held[0][order], held[1][order]), []
                    trained = np.zeros(len(order), bool)
                at = np.searchsorted(held[0], ms[lo:hi])
                for n in range(lo, hi):
                    if kinds[n] == 1:
                        if user is not None:
                            done.append((user, p.tolist()))
                        user, p = int(us[n]), np.array(xs[n].as_py(), float)
                        continue
                    k = at[n - lo]
                    q = held[1][k].copy()
                    e = vs[n] - p @ q
                    p, held[1][k] = p + rate * (e * q - penalty * p), q + rate * (e * p - penalty * q)
                    trained[k] = True
            if done:
                yield packed("u", [u for u, _ in done], [x for _, x in done])
                done = []
        if user is not None:
            yield packed("u", [user], [p.tolist()])
        yield from items()

    place = lambda name: F.pmod(F.xxhash64(name), F.lit(parts))
    none = lambda kind: F.lit(None).cast(kind)
    for _ in range(epochs):
        for s in range(parts):
            stratum = dealt.where(F.pmod(F.col("a") + s, F.lit(parts)) == F.col("b")).where("user is not null and item is not null and v is not null").select("a", F.lit(2).alias("kind"), F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), "v", none("array<double>").alias("x"))
            raters = stratum.select("user").distinct()
            heads = users.join(raters.withColumnRenamed("user", "id"), "id", "left_semi").select(place("id").alias("a"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("user"), none("long").alias("item"), none("double").alias("v"), "x")
            # an item of part b meets the users of part b - s
            first = items.select(F.pmod(place("id") - s, F.lit(parts)).alias("a"), F.lit(0).alias("kind"), none("long").alias("user"), F.col("id").cast("long").alias("item"), none("double").alias("v"), "x")
            rows = first.union(heads).union(stratum).repartition(max(64, 8 * parts), "a").sortWithinPartitions("a", F.col("kind") > 0, "user", "kind", "item", "v")
            rows = rows.select("a", "kind", F.coalesce("user", F.lit(0)).alias("user"), F.coalesce("item", F.lit(0)).alias("item"), F.coalesce("v", F.lit(0.0)).alias("v"), "x")
            new = kept(rows.mapInArrow(train, "side string, id long, x array<double>"))
            merge = lambda old, side: kept(old.join(new.where(F.col("side") == side).select("id", F.col("x").alias("y")), "id", "left").select("id", F.coalesce("y", "x").alias("x")))
            users, items = merge(users, "u"), merge(items, "m")
    return users, items


# topics: counts (doc, term, n)


def lda(counts: DataFrame, topics: int, terms: int, iterations: int = 10, alpha: float = 0.1, eta: float = 0.1, seed: int = 1) -> np.ndarray:
    """Topic-term shares by collapsed variational Bayes of order zero: each round, every document's responsibilities are found from the common topics, and their counts are summed. terms are numbers below ``terms``."""
    docs = counts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("cells")).select(F.transform("cells", lambda c: c["term"]).alias("t"), F.transform("cells", lambda c: c["n"].cast("double")).alias("n"))
    model = np.random.default_rng(seed).random((topics, terms)) + 0.5
    for _ in range(iterations):
        share = (model + eta) / (model + eta).sum(1, keepdims=True)

        def run(batches: Iterator[pa.RecordBatch], beta=share) -> Iterator[pa.RecordBatch]:
            total = np.zeros((topics, terms))
            for batch in batches:
                for t, n in zip(batch.column(0), batch.column(1), strict=True):
                    at, own = t.values.to_numpy(), n.values.to_numpy(zero_copy_only=False)
                    theta = np.full(topics, own.sum() / topics)
                    for _ in range(10):
                        r = beta[:, at] * (theta + alpha)[:, None]
                        r /= np.maximum(r.sum(0), 1e-300)
                        theta = r @ own
                    total[:, at] += r * own
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

        table = docs.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        model = np.zeros((topics, terms))
        model[table.column("i").to_numpy(), table.column("j").to_numpy()] = table.column("v").to_numpy()
    return (model + eta) / (model + eta).sum(1, keepdims=True)


def lda_table(counts: DataFrame, topics: int, iterations: int = 10, alpha: float = 0.1, eta: float = 0.1, seed: int = 1) -> DataFrame:
    """(topic, term, v): as lda, for terms of any kind and number. The topic-term table stays a DataFrame, a row for each term; documents meet their own terms' rows only, and the driver holds one number for each topic."""
    counts = kept(counts.groupBy("doc", "term").agg(F.sum("n").cast("double").alias("n")))
    kind = dict(counts.dtypes)["term"]
    start = [F.pmod(F.xxhash64("term", F.lit(k), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) + 0.5 for k in range(topics)]
    size = counts.select("term").distinct().count()
    model = kept(counts.select("term").distinct().select("term", F.array(*start).alias("w")))

    def totals() -> np.ndarray:
        sums = model.agg(*[F.sum(F.col("w")[k]).alias(f"t{k}") for k in range(topics)]).first()
        return np.array([x or 0.0 for x in sums]) + eta * size

    for _ in range(iterations):

        def run(batches: Iterator[pa.RecordBatch], whole=totals()) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cells in batch.column(0):
                    terms, own, w = (cells.values.field(c) for c in ("term", "n", "w"))
                    own = own.to_numpy()
                    beta = (linalg.stacked(w, topics) + eta).T / whole[:, None]
                    theta = np.full(topics, own.sum() / topics)
                    for _ in range(10):
                        r = beta * (theta + alpha)[:, None]
                        r /= np.maximum(r.sum(0), 1e-300)
                        theta = r @ own
                    yield pa.RecordBatch.from_arrays([terms, *(r * own)], names=["term", *(f"w{k}" for k in range(topics))])

        docs = counts.join(model, "term").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "n", "w"))).alias("cells")).select("cells")
        found = docs.mapInArrow(run, f"term {kind}, " + ", ".join(f"w{k} double" for k in range(topics)))
        model = kept(found.groupBy("term").agg(F.array(*[F.sum(f"w{k}") for k in range(topics)]).alias("w")))
    whole = totals()
    return model.select("term", F.posexplode("w").alias("topic", "w")).select(F.col("topic").cast("long").alias("topic"), "term", ((F.col("w") + eta) / F.element_at(F.array(*[F.lit(float(x)) for x in whole]), F.col("topic") + 1)).alias("v"))
