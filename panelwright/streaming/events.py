"""Event-time windows over a stream of events; the batch form is the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping_counts(events: DataFrame, size: str = "2 hours", hop: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, v) by hopping window; a stream drops rows later than ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    found = rows.groupBy(F.window("ts", size, hop).alias("win"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return found.select(F.col("win.start").alias("start"), "event_type", "n", "v")
