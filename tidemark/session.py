"""Session defaults for telemetry jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC because timestamps are wall-clock nanoseconds; adaptive execution splits skewed joins and merges small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
