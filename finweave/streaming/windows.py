"""Event-time windows over streams or tables of events (ts, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Parquet files that land in a folder, a few each trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp with a watermark; state older than it is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _totals(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.max("value").alias("top"))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    g = _totals(events.groupBy(F.window("ts", size), "event_type"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "events", "total", "top")


def hopping(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    g = _totals(events.groupBy(F.window("ts", size, step), "event_type"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "events", "total", "top")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events with less than the gap between them."""
    g = _totals(events.groupBy(F.session_window("ts", gap), "user_id"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "events", "total", "top")
