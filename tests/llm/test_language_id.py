import binascii

from gridloom.llm import hdlang, queries

from .conftest import make, messy


def test_held_out_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_do_not_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(hdlang.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda d: sorted(map(tuple, hdlang.language_id(d).select("doc_id", "lang_pred").collect()))
    assert key(docs) == key(other)


def test_messy(spark):
    docs = messy()
    got = hdlang.language_id(make(spark, docs)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1003].lang_pred == by[1004].lang_pred == by[1005].lang_pred == "und" and by[1003].score == 0
    assert by[1006].lang_pred == "en"
    assert hdlang.language_id(make(spark, [])).count() == 0
    unknown = spark.createDataFrame([(1, "text", None), (2, "12 !", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in hdlang.language_id(unknown).collect()} == {"und"}


def test_parts_give_the_same(monkeypatch):
    """Blocks bound the memory and change nothing."""
    texts = [t for _, t in messy()]
    symbols, _ = hdlang.letter_table(hdlang.DIMENSIONS)
    want = [x.tolist() for x in hdlang.trigrams(texts, symbols)]
    monkeypatch.setattr(hdlang, "BLOCK_CHARS", 50)
    assert [x.tolist() for x in hdlang.trigrams(texts, symbols)] == want
