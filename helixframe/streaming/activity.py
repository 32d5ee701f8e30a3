"""Streams: the row-local read operators run on them as they are; counts by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) by tumbling windows of ``ts``; rows later than ``late`` are left out of a stream."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")
