"""Structured Streaming forms of the causal features over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_activity(events: DataFrame, window: str = "24 hours", slide: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(user_id, start, n, total) over sliding windows; events later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    grouped = timed.groupBy(F.window("ts", window, slide), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """(user_id, start, n) of sessions that a gap ends."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    grouped = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")
