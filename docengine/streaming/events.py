"""Windows over event streams (an extension: the reference streams progress only). All work on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """start, event_type, n, total in windows of `size`; events later than `late` are left out of a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """user_id, start, n of the sessions of each user."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Each key once; a stream forgets keys older than `late`."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def progress(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Latest event of each key and its number of events (for output mode complete or update)."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))
