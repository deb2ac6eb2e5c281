"""Token counts as delta-maintained rollups.

A store is a folder of committed batches. A batch of changes becomes signed rows
of a log, (doc_id, source, lang, version, docs, tokens): +1 and +tokens for what
a document now counts, -1 and -tokens for what it counted so far, which the log
itself tells, as the sum of the document's signed rows. The batch's rows,
summed by source, language and tokenizer version, are its rollup delta, and the
totals are the sum of all deltas. Documents are only looked at when they change.

A commit is idempotent: the delta's _SUCCESS marker, written last, makes a batch
count; a batch id that has one is left alone, and one that was broken off is
written anew. One writer at a time is assumed. The signed rows of a batch are
joined to the log by document id and combined before every shuffle; the totals
have a row for each source, language and version only.

Defined results: null sources and languages form groups of their own; a null
token count counts as 0; rows that repeat a doc_id within a batch count each,
and a later change replaces or deletes all of them; rows without doc_id are
added and can't be changed; a deletion of an unknown document, or an empty
batch, changes nothing; groups without documents are left out of the totals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GROUP = ("source", "lang", "version")
LOG = "doc_id long, source string, lang string, version string, docs long, tokens long"
#: Tokenizer versions that SQL functions can count: all words, and the words of letters and digits.
WORDS, ALNUM = ("words-1", r"[^\x20\x09-\x0D]+"), ("alnum-2", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def counted(docs: DataFrame, version: str, pattern: str) -> DataFrame:
    """(doc_id, source, lang, version, tokens) of whole texts by an expression; capital letters fold for expressions that leave them out."""
    text = F.coalesce("text", F.lit(""))
    text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if version == ALNUM[0] else text
    return common.only(docs, "doc_id", "source", "lang", "text").select("doc_id", "source", "lang", F.lit(version).alias("version"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("tokens"))


class TokenRollup:
    """The totals of a store at ``path``, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = None

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def committed(self) -> list[str]:
        """The folders of all batches that count."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(top):
            return []
        return sorted(x for s in fs.listStatus(top) if self._exists(f"{(x := s.getPath().toString())}/rollup/_SUCCESS"))

    def _batch(self, batch_id: str) -> str:
        return f"{self.path}/batch-{batch_id.encode().hex()}"

    def _read(self, part: str, schema: str) -> DataFrame:
        own = [f"{b}/{part}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def documents(self, ids: DataFrame | None = None) -> DataFrame:
        """What each document counts now (of these ids only, if given)."""
        log = self._read("log", LOG)
        if ids is not None:
            log = log.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return log.groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch: upserts (doc_id, source, lang, version, tokens) replace what their documents counted, deletes (doc_id) take it away. False if the batch was committed before."""
        to = self._batch(batch_id)
        if self._exists(f"{to}/rollup/_SUCCESS"):
            return False
        names = ["doc_id", *GROUP, "docs", "tokens"]
        parts, touched = [], []
        if upserts is not None:
            parts.append(upserts.select(F.col("doc_id").cast("long").alias("doc_id"), *GROUP, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens")))
            touched.append(upserts.select(F.col("doc_id").cast("long").alias("doc_id")))
        if deletes is not None:
            touched.append(deletes.select(F.col("doc_id").cast("long").alias("doc_id")))
        if touched and self.committed():
            ids = touched[0] if len(touched) == 1 else touched[0].union(touched[1])
            parts.append(self.documents(ids).select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        signed = self.spark.createDataFrame([], LOG)
        for p in parts:
            signed = signed.union(p.select(*names))
        signed.write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/log")
        delta = self.spark.read.schema(LOG).parquet(f"{to}/log").groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(f"{to}/rollup")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens."""
        every = self._read("rollup", "source string, lang string, version string, docs long, tokens long")
        summed = every.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")


def maintained(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """The totals after four commits: all documents; those labelled of high quality counted anew with another tokenizer version; those labelled toxic deleted; and the second batch once more, which changes nothing."""
    spark = docs.sparkSession
    store = TokenRollup(spark, path or f"{common.shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    store.commit("load", counted(docs, *WORDS))
    good = common.only(labels, "doc_id", "quality").where("quality = 1").select("doc_id").distinct()
    toxic = common.only(labels, "doc_id", "toxic").where("toxic = 1").select("doc_id")
    for _ in range(2):
        store.commit("recount", counted(docs, *ALNUM).join(good, "doc_id"))  # counts are joined, not texts: a semi join would be pushed below the counting
        store.commit("takedown", deletes=toxic)
    return store.totals()


ORACLE_SQL = r"""
WITH d AS (
  SELECT source, lang, text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
)
SELECT source, lang, CASE WHEN good THEN 'alnum-2' ELSE 'words-1' END AS version, count(*) AS n_docs,
       sum(CASE WHEN good THEN len(regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
                ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END)::BIGINT AS n_tokens
FROM d GROUP BY ALL
"""
