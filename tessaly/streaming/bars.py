"""Event-time bars over a stream: late rows within the watermark count, a bar leaves once it can't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(events: DataFrame, time: str, key: str, value: str, length: str, late: str) -> DataFrame:
    """First, highest, lowest, last value and count by key and tumbling window, for a stream or a table alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    grouped = marked.groupBy(F.window(time, length).alias("w"), key)
    out = grouped.agg(F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "open", "high", "low", "close", "n")
