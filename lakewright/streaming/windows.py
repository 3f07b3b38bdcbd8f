"""Windowed counts of an event stream (beyond the reference, which has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time_col: str = "ts", key_col: str = "event_type") -> DataFrame:
    """window_start, key, n of a stream or a table; on a stream, events later than late are dropped and state is let go."""
    events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks need a zone
    if events.isStreaming:
        events = events.withWatermark(time_col, late)
    counted = events.groupBy(F.window(time_col, width).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "key", "n")
