"""Running metrics of an event stream: the same function serves a stream and a table.

An extension: batch summaries by window, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, mean, std, min, max) of events (ts, event_type, value)."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    out = out.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])
