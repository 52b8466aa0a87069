"""Windows over event time, for streams and tables alike; watermarks bound the state of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarks take instants: a time without zone is taken for one of the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None, by: tuple[str, ...] = ("event_type",), time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """start and end of tumbling or sliding windows, with the number of events and the sum of their values."""
    at = F.window(time, size, slide) if slide else F.window(time, size)
    rows = _late(events, time, delay).groupBy(at, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: tuple[str, ...] = ("user_id",), time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    rows = _late(events, time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
