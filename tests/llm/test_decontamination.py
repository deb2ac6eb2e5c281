import hashlib
import random

from gridloom.llm import fm_index, queries

from .conftest import make, messy


def expected(docs, items):
    out = []
    for (i, _), (n, hit, found) in zip(docs, fm_index.brute_force([t for _, t in docs], items)):
        out.append((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    return sorted(out, key=str)


def test_messy_against_brute_force(spark):
    docs = messy()
    r = random.Random(3)
    items = [(1, None), (2, ""), (3, "!!"), (None, "w1 w2"), (4, "one"), (5, "A-B"), (10, "A-B"), (5, "A-B")]
    for k in range(30):
        w = r.choice(docs)[1]
        w = (w or "zz").split()
        at = r.randrange(len(w))
        items.append((20 + k, " ".join(w[at : at + r.choice([3, 10, 25])]).upper()))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for size in (fm_index.PHRASE_BLOCK_BYTES, 300):
        got = fm_index.digest(fm_index.decontaminate(make(spark, docs), bench, block_bytes=size))
        assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)


def test_empty_tables(spark):
    docs, bench = make(spark, messy()), spark.createDataFrame([], "item_id long, text string")
    assert fm_index.digest(fm_index.decontaminate(docs, bench)).where("contaminated").count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert fm_index.digest(fm_index.decontaminate(docs.where("false"), some)).count() == 0


def test_clean_text(spark):
    docs = make(spark, [(1, "keep this, the Secret phrase! and that")])
    some = spark.createDataFrame([(1, "secret PHRASE")], "item_id long, text string")
    assert fm_index.decontaminate(docs, some, texts=True).first().clean_text == "keep this, the ! and that"


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op2_decontamination(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)
    assert got.where("contaminated").count() > 0
