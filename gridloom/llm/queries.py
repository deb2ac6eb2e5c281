"""The registered queries of the training-data operators: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import common, fm_index, hdlang, html_templates, pieces, pii, suffix_automata, suffix_levels, superminhash, token_rollup, topk

#: Where the public tokenizers' files are; a parameter, not part of this repository.
TOKENIZERS = os.environ.get("GRIDLOOM_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(common.table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(fm_index.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automata.dedup(common.table(spark, sf_dir, "documents")).drop("spans", "kept_text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdlang.language_id(common.table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(common.table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(common.table(spark, sf_dir, "documents")))


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.dedup(common.table(spark, sf_dir, "documents")).drop("spans", "kept_bytes")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(common.table(spark, sf_dir, "documents"), k=2, percent=80)


EVERY = (
    op1_html_extraction,
    op2_decontamination,
    op3_substring_dedup,
    op4_language_id,
    op5_exact_top_k,
    op6_sentencepiece,
    op7_pii,
    op8_suffix_levels,
    op9_token_rollup,
    op10_superminhash,
)


def queries() -> dict:
    return {f.__name__: f for f in EVERY}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": topk.ORACLE_SQL, "op9_token_rollup": token_rollup.ORACLE_SQL}
