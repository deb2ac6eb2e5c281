import duckdb

from gridloom.llm import queries, token_rollup

from .conftest import make, messy

ROW = "doc_id long, source string, lang string, version string, tokens long"


def totals(store):
    return sorted(map(tuple, store.totals().collect()), key=str)


def test_commits(spark, tmp_path):
    store = token_rollup.TokenRollup(spark, f"file://{tmp_path}/store")
    assert totals(store) == []
    first = spark.createDataFrame([(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, None, "v1", 7), (None, "a", "en", "v1", 1), (4, "b", "de", "v1", None), (5, "b", "de", "v1", 2), (5, "b", "de", "v1", 2)], ROW)
    assert store.commit("one", first) and not store.commit("one", first)
    assert totals(store) == sorted([("a", "en", "v1", 3, 16), (None, None, "v1", 1, 7), ("b", "de", "v1", 3, 4)], key=str)
    # a revision moves a document to another tokenizer version and source
    assert store.commit("two", spark.createDataFrame([(1, "b", "en", "v2", 30), (5, "b", "de", "v1", 9)], ROW), spark.createDataFrame([(3,), (77,), (None,)], "doc_id long"))
    want = sorted([("a", "en", "v1", 2, 6), ("b", "en", "v2", 1, 30), ("b", "de", "v1", 2, 9)], key=str)
    assert totals(store) == want
    assert store.commit("empty", first.where("false")) and store.commit("none")
    assert totals(store) == want
    # a broken-off batch doesn't count, and is written anew
    import shutil

    path = store._batch("three").removeprefix("file://")
    first.selectExpr("doc_id", "source", "lang", "version", "1L docs", "tokens").write.parquet(f"{path}/log")
    assert totals(store) == want and sorted(store.documents().where("doc_id = 1").collect())[0].version == "v2"
    assert store.commit("three", deletes=spark.createDataFrame([(1,)], "doc_id long"))
    assert totals(store) == [r for r in want if r[2] != "v2"]
    # deleting and adding the same document again
    assert store.commit("four", spark.createDataFrame([(1, "a", "en", "v2", 4)], ROW))
    assert ("a", "en", "v2", 1, 4) in totals(store)
    shutil.rmtree(tmp_path)


def test_messy_against_sql(spark):
    docs = messy()
    labels = [(7, 1, 0), (10, 0, 1), (10, 0, 1), (13, 1, 1), (1002, 1, 0), (None, 1, 1), (16, None, None), (1008, 1, 0)]
    got = token_rollup.maintained(make(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, 'en', null)", [(i, None if t is None else t) for i, t in docs])
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(token_rollup.ORACLE_SQL).fetchall(), key=str)
    assert token_rollup.maintained(make(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_whole_table(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.op9_token_rollup(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(token_rollup.ORACLE_SQL).fetchall(), key=str)
