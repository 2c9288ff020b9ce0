"""SparkSession factory with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "finweave", **conf: str) -> SparkSession:
    """ANSI mode and adaptive execution stay on, times are UTC; the rest
    (master, memory, partitions) is the cluster's own."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
