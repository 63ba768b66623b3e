"""Streams of captures and events, over the same columns as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_spend(events: DataFrame, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum of value by window and event type; events later than the watermark are dropped by it."""
    time = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(time.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_captures(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
