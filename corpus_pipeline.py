"""A training-data pipeline of five stages; each takes documents and returns documents, the last one returns token ids.

Every stage works on all that the stage before kept, and its result is written
as Parquet and read again. All stages but the last return the columns that they
got, whatever those are besides doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, fm_index, hdlang, pieces, pii, queries, superminhash

SHINGLE_WORDS, PERCENT = 5, 80


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang by name, all other columns by number: whatever they are called, they clash with nothing."""
    return docs.select(*[F.col(f"`{n}`").alias(n if n in ("doc_id", "text", "lang") else f"c{i}") for i, n in enumerate(docs.columns)])


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs by their names. n_chars follows the text."""
    kinds = dict(docs.dtypes)
    number = lambda i, n: F.col(n) if n in ("doc_id", "text", "lang") else F.length("text").cast(kinds[n]) if n == "n_chars" else F.col(f"c{i}")
    return df.select(*[number(i, n).alias(n) for i, n in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned; lang becomes the predicted one. Those without text or letters (`und`) go; short texts, whose scores are low, stay."""
    own = _plain(docs)
    bundles = hdlang.prototypes(own.where(~hdlang.held_out()))
    found = hdlang.identify(own, bundles, own.columns, keep_text=True)
    return _restored(found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id. Of rows that repeat a doc_id the least one stays; rows without doc_id all stay."""
    own = _plain(docs)
    result = common.cut(superminhash.near_duplicates(own, k=SHINGLE_WORDS, percent=PERCENT), "near")
    gone = result.where("not kept").select(F.col("doc_id").alias("other")).distinct()
    left = own.join(superminhash.by_size(gone), F.col("doc_id") == F.col("other"), "left_anti")
    repeated = result.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("other"))
    if not repeated.isEmpty():
        same = superminhash.by_size(repeated)
        least = left.join(same, F.col("doc_id") == F.col("other"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*own.columns)).alias("least"))
        left = left.join(same, F.col("doc_id") == F.col("other"), "left_anti").unionByName(least.select("least.*"))
    return left.toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; documents of which nothing is left go."""
    own = _plain(docs)
    found = fm_index.decontaminate(own, common.table(spark, sf_dir, "benchmark"), texts=True, carried=tuple(own.columns))
    left = found.where("n_hit = 0 or n_hit < n_words")
    return _restored(left.withColumn("text", F.coalesce("clean_text", "text")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets."""
    found = pii.with_spans(_plain(docs))
    return _restored(found.withColumn("text", pii.redact(F.col("text"), F.col("pii_spans"))), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and the decoded text."""
    return pieces.encode(docs, queries.tokenizer_path(queries.PIECE_MODEL), "doc_id", "source", "lang")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", sentencepiece),
]
#: No SQL for these rows: see tests/llm/test_pipeline.py for the check against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
