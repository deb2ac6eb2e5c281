import numpy as np

from gridloom.llm import queries, topk


def brute(rows, every=20, k=20):
    fit = [(i, np.floor(64 * np.array(x, np.float64))) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, x in fit:
        if q % every == 0:
            scores = sorted((-int(x @ y), i) for i, y in fit if i != q and len(x) == len(y))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_messy(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.integers(-3, 4, 8)]) for i in range(300)] + [(i + 300, [1.0] * 8) for i in range(50)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [1.0] * 8), (480, []), (500, [1.0, 2.0]), (520, [3.0, 4.0]), (540, [1e200] * 8), (541, [-1e200] * 8)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, id int, q int")
    ok = [(i, x) for i, x in rows if i not in (540, 541)]
    got = topk.top_k(df.where("vec_id is null or vec_id not in (540, 541)"), df.where("vec_id % 20 = 0 and vec_id <> 540"))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(ok)
    assert topk.top_k(df, df.where("vec_id = 540")).count() == 20
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op5_exact_top_k(spark, sf).collect())) == brute(rows)
