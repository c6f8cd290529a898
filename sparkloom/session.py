"""A session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **more: str) -> SparkSession:
    """UTC, adaptive execution and skew joins on; anything may be overridden."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | more
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
