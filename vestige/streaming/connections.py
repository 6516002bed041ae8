"""Connections over a stream of state changes: the batch windows' gap rule as session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_sessions(changes: DataFrame, gap: str = "15 seconds", late: str = "1 hour") -> DataFrame:
    """Per device runs of changes (device_key, time_utc, state) that follow one another within the gap: their first
    and last time and the numbers of arrivals and departures. Works on batches and, with changes up to `late`
    behind the newest, on streams in append mode."""
    timed = changes.withColumn("at", F.col("time_utc").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    out = timed.groupBy("device_key", F.session_window("at", gap)).agg(F.count_if(F.col("state") == "arrival").alias("arrivals"), F.count_if(F.col("state") == "departure").alias("departures"))
    return out.select("device_key", F.col("session_window.start").alias("first_utc"), F.col("session_window.end").alias("closed_utc"), "arrivals", "departures")
