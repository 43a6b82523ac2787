"""Structured Streaming over landed snapshots and events (beyond parity with batch scans)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_landing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_batches(stream: DataFrame, target: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write each micro-batch into its own folder `batch=<id>`; a batch that is run again replaces its own folder only,
    so records are neither lost nor repeated after a failure."""

    def write(batch: DataFrame, number: int) -> None:
        (keep(batch) if keep else batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(changes: DataFrame, time: str = "landed_at", late: str = "14 days", window: str = "1 day") -> DataFrame:
    """Changes per window and status; rows later than the watermark are dropped by the engine."""
    return changes.withWatermark(time, late).groupBy(F.window(time, window), "status").agg(F.count("*").alias("n"))
