"""Windowed aggregation of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, events, total of each window and key; works on streams and on tables.

    State of a window is dropped once the watermark has passed it, so it stays bounded.
    """
    data = events.withColumn(time, F.col(time).cast("timestamp"))
    data = data.withWatermark(time, late) if events.isStreaming else data
    grouped = data.groupBy(F.window(time, window).alias("w"), F.col(key).alias("key"))
    total = F.sum(F.col(value).cast("decimal(18,4)")).cast("double")
    return grouped.agg(F.count("*").alias("events"), total.alias("total")).select(F.col("w.start").alias("window_start"), "key", "events", "total")
