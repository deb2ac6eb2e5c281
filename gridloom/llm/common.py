"""Session helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept, shared_dir, ship


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, and a lost executor costs only a read."""
    return kept(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def small_rows(df: DataFrame, limit_bytes: int, size) -> Iterable[list]:
    """Rows in driver-side blocks whose sizes, as ``size(row)`` tells, sum up to at most limit_bytes (a single larger row is a block of its own). Rows come one partition at a time."""
    block, total = [], 0
    for row in df.toLocalIterator():
        n = size(row)
        if block and total + n > limit_bytes:
            yield block
            block, total = [], 0
        block.append(row)
        total += n
    if block:
        yield block


__all__ = ["cut", "only", "parallelism", "shared_dir", "small_rows", "table"]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
