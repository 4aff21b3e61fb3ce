"""Readers of text logs: JSON lines with validation, metric expositions, free text.

Bad lines become rows with a reason, never exceptions. Payloads stay text, so that integers beyond 2**53 survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: fields that an event must have, but for null ones.
ENVELOPE = (
    "schema_version string, event_type string, ts_wall_ns bigint, ts_mono_ns bigint, process_start_wall_ns bigint, process_start_mono_ns bigint, host_id string, component string, process_id int, process_instance_id string, "
    "event_seq bigint, experiment_id string, run_id string, config_id string, trace_id string, attempt_id int, request_id string, external_request_id string, payload string"
)
#: Fixed value: fields that may be null but must be there.
NULLABLE = ("trace_id", "attempt_id", "request_id", "external_request_id", "config_id", "experiment_id")


def validated(lines: DataFrame, schema: str, seq: str = "seq", payload: str = "payload", nullable: tuple[str, ...] = (), version: str | None = None, attempt: str | None = None) -> DataFrame:
    """Typed rows of JSON lines (column ``value``), with ``line`` and ``damage``: why a line isn't an event, else null.

    Every field must be there; only ``nullable`` ones may be null. With ``version``, schema_version must be that; ``attempt``
    names a number that, if not null, isn't negative. Other columns of lines are kept.
    """
    more = [c for c in lines.columns if c != "value"]
    whole = T.StructType.fromDDL(f"{schema}, _corrupt string")
    x = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = [f for f in whole.fieldNames() if f != "_corrupt"]
    rows = lines.select(F.col("value").alias("line"), *more, x.alias("x"), F.json_object_keys("value").alias("_keys") if nullable else F.lit(None).cast("array<string>").alias("_keys"))
    gone = F.lit(False)
    for n in names:
        gone = gone | (~F.coalesce(F.array_contains("_keys", n), F.lit(False)) if n in nullable else F.col(f"x.{n}").isNull())
    damage = F.when(F.col("x._corrupt").isNotNull() | F.col("x").isNull(), "not_json").when(gone, "field_missing")
    if version:
        damage = damage.when(F.col("x.schema_version") != version, "unsupported_schema_version")
    damage = damage.when(F.col(f"x.{seq}") <= 0, "sequence_not_positive")
    if attempt:
        damage = damage.when(F.col(f"x.{attempt}") < 0, "attempt_negative")
    damage = damage.when(~F.startswith(F.ltrim(F.col(f"x.{payload}")), F.lit("{")), "payload_not_object")
    return rows.select("line", *more, damage.alias("damage"), *(F.col(f"x.{n}").alias(n) for n in names))


def event_rows(lines: DataFrame, version: str | None = None) -> DataFrame:
    """Lines as events with the whole envelope; with ``version``, events of another one are damaged."""
    return validated(lines, ENVELOPE, "event_seq", nullable=NULLABLE, version=version, attempt="attempt_id")


def numbered(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(value, source_file, line) of every line under path; lines count from 1 in each file, empty ones too.

    Spark deals files to tasks by byte ranges. Rows of one range are in one task and in order, so a line's place there is
    its running number less the range's first; lines of the ranges before it are counted by an aggregation of a row for each.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    ranges = rows.groupBy("source_file", "_block").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    before = F.coalesce(F.sum("_lines").over(W.partitionBy("source_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(ranges.select("source_file", "_block", "_first", before.alias("_before")), ["source_file", "_block"]).select("value", "source_file", (F.col("_before") + F.col("_n") - F.col("_first") + 1).alias("line"))


def read_events(spark: SparkSession, path: str, glob: str = "*.jsonl", version: str | None = None) -> DataFrame:
    """All lines under a run's folder as validated events, with their source_file, source_line and the component whose folder they are in (source_component)."""
    raw = numbered(spark, path, glob)
    return event_rows(raw.select("value", "source_file", F.col("line").alias("source_line"), F.element_at(F.split("source_file", "/"), -2).alias("source_component")), version)


def ordered(events: DataFrame, wall: bool = False) -> DataFrame:
    """Events by process and sequence, or by wall time and sequence: sorted by ranges, so that files of a table follow one another."""
    return events.orderBy("ts_wall_ns", "event_seq") if wall else events.orderBy("process_instance_id", "event_seq")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Writer summaries, one file each."""
    schema = "process_instance_id string, events_enqueued bigint, events_written bigint, events_dropped bigint"
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.summary.json").json(path)


def prometheus(lines: DataFrame) -> DataFrame:
    """(name, labels, number) of each sample line; comments and malformed lines give none."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{.*\})?\s+([-+0-9.eE]+|NaN|[+-]?Inf)\s*$"
    rows = lines.where(~F.startswith("value", F.lit("#")))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select(part(1).alias("name"), part(2).alias("labels"), part(3).alias("_t")).where("name <> ''").select("name", "labels", F.expr("try_cast(_t AS double)").alias("number"))


def extracted(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """The groups of the pattern's first match in each line that has one."""
    rows = lines.where(F.rlike("value", F.lit(pattern)))
    return rows.select(*(F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)))
