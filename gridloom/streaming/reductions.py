"""Reductions that are kept up to date as elements arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Sums, counts and extremes of a key in windows of event time; state older than the watermark goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def totals_so_far(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The event table read as a stream of files, reduced by kind: the state after everything there has arrived."""
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-8]}*.parquet")
    totals = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    base, out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out-{number}")
        out["path"] = f"{base}/out-{number}"

    query = totals.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(out["path"])
