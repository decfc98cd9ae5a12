"""Streaming versions of breakdown and period totals over an event-time column, with watermarks.

An extension: these add to the batch operators, on Structured Streaming, with the same keys and measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import AMOUNT


def windowed_breakdown(events: DataFrame, time: str, by: str, value: str, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """start, key, count, total by event-time window; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    got = events.withWatermark(time, late).groupBy(w.alias("w"), F.coalesce(F.col(by).cast("string"), F.lit("(blank)")).alias("key")).agg(F.count("*").alias("count"), F.sum(F.col(value).cast(AMOUNT)).alias("total"))
    return got.select(F.col("w.start").alias("start"), "key", "count", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """start, end, user, events of each visit that ends with a pause."""
    got = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(user).alias("user")).agg(F.count("*").alias("events"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user", "events")
