"""Incremental refresh of hourly means with a finality watermark; rows later than it no longer change a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINALITY = "60 days"


def hourly_stream(rows: DataFrame, key: str, t: str, v: str, finality: str = FINALITY) -> DataFrame:
    """Hourly means of a stream (or of a table: the same plan); t is the end of the hour."""
    timed = rows.withColumn("_t", F.col(t).cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark("_t", finality)
    out = timed.groupBy(F.window("_t", "1 hour"), F.col(key).alias("key")).agg(F.avg(v).alias("v"), F.count(v).alias("n"))
    return out.select("key", F.col("window.end").alias("t"), "v", "n")


def upsert_partitions(folder: str, partition: str):
    """A foreachBatch function that overwrites only the partitions that a batch holds, so a replayed batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)

    return write
