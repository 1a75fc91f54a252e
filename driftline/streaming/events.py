"""Windowed counts of an event stream, and a change log that is extended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) by hour. On a stream, rows later than `late` are dropped; a batch has none."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"),
        F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def extend(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of new changes to `apply` once; `checkpoint` remembers what was handed over."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
