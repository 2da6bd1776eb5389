"""Structured Streaming operators on event rows; batch semantics and streaming semantics agree once a bounded input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling_counts(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_counts(events: DataFrame, size: str = "2 days", slide: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key; state is bounded by the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)
