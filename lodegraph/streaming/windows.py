"""Windowed, sessioned and de-duplicated streams, and a resumable progress log."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.session import ensure_checkpoint_dir


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; later than the watermark does not count in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding_budget(events: DataFrame, size: str = "60 seconds", step: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """What each user spends per sliding window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "user_id").agg(F.sum("value").alias("spent")).select(F.col("window.start").alias("start"), "user_id", "spent")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events with no longer pause than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of equal events within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_unseen(stream: DataFrame, target: str, keys: list[str], checkpoint: str | None = None):
    """Starts a query that appends to a Parquet table the rows whose keys it does not hold yet: a restart or a repeated
    batch adds nothing twice."""
    spark = stream.sparkSession
    where = checkpoint or f"{ensure_checkpoint_dir(spark)}/streams/{hashlib.sha256(target.encode()).hexdigest()[:16]}"

    def write(batch: DataFrame, _: int) -> None:
        from lodegraph.sources.readers import exists

        fresh = batch.dropDuplicates(keys)
        if exists(spark, target):
            fresh = fresh.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", where).trigger(availableNow=True).start()
