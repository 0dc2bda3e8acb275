"""Structured Streaming analogues: segments, gap sessions, first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments(events: DataFrame, width: str = "35 seconds", late: str = "10 minutes") -> DataFrame:
    """Events a user and fixed segment; works on streams (with a watermark) and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("top")).select("user_id", F.col("window.start").alias("start"), "n", "top")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row of each key; a stream forgets keys behind the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
