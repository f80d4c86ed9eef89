"""Structured Streaming forms of the change log, the file watch and the access counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, directory: str, schema: str, per_batch: int = 512) -> DataFrame:
    """A stream of the rows of Parquet files as they arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(directory)


def watch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Hand each coalesced micro-batch to ``handle`` with its number. A batch replayed after a
    failure has the same number, so writing by number keeps every row exactly once."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=debounce)).start()


def access_counts(events: DataFrame, lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """Accesses per window and type of a stream (ts, event_type, event_id); a repeated delivery
    counts once while it is within the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
