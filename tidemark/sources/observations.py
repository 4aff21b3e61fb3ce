"""Observation logs, configuration values and matrices of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observations(lines: DataFrame) -> DataFrame:
    """(ts, engine, metrics, error) of JSON lines with ISO timestamps; what can't be parsed stays as a row with its reason."""
    x = F.from_json("value", "timestamp string, engine string, metrics map<string,double>, error string")
    ts = F.try_to_timestamp(x["timestamp"])
    reason = F.when(x.isNull() | x["timestamp"].isNull(), "not_json").when(ts.isNull(), "bad_timestamp").otherwise(x["error"])
    return lines.select(ts.alias("ts"), x["engine"].alias("engine"), x["metrics"].alias("metrics"), reason.alias("error"))


def config_values(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value) of ``key: value`` lines, quotes taken off; the first line of a key counts. lines: (n, value)."""
    found = lines.select("n", F.regexp_extract("value", r"^\s*([A-Za-z_][A-Za-z0-9_.-]*)\s*[:=]\s*['\"]?(.*?)['\"]?\s*$", 1).alias("key"), F.regexp_extract("value", r"^\s*[A-Za-z_][A-Za-z0-9_.-]*\s*[:=]\s*['\"]?(.*?)['\"]?\s*$", 1).alias("v"))
    return found.where(F.col("key").isin(keys)).groupBy("key").agg(F.min_by("v", "n").alias("value"))


def matrix(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Vectors (split, run_id, window_id, x: array<double>) written as a table; the split prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df
