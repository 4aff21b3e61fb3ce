"""The event log as a stream: window counts with a watermark, sequence gaps and whole lifecycles with state, replayable batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.linear import importable
from tidemark.operators.events import attempts, lifecycle_violations, traces
from tidemark.sources.logs import ENVELOPE, event_rows


def read(spark: SparkSession, path: str, files_at_once: int = 100, version: str | None = None) -> DataFrame:
    """Validated events of JSON-line files as they appear under path."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").text(path)
    return event_rows(raw.select("value"), version)


def window_counts(events: DataFrame, period: str, late: str) -> DataFrame:
    """(start, run_id, event_type, n) of tumbling windows over wall time; events later than ``late`` are left out."""
    ts = F.timestamp_micros(F.call_function("div", F.col("ts_wall_ns"), F.lit(1000).cast("long")))  # display and watermark only: microseconds
    kept = events.where("damage is null").withColumn("ts", ts).withWatermark("ts", late)
    return kept.groupBy(F.window("ts", period), "run_id", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "run_id", "event_type", "n")


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(run_id, process_instance_id, expected, found) of each jump; the state is one number for each process."""
    importable(events.sparkSession)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        found = []
        for seq in sorted(s for p in parts for s in p["event_seq"]):
            if seq != last + 1:
                found.append((*key, last + 1, seq))
            last = max(last, seq)
        state.update((int(last),))
        yield pd.DataFrame(found, columns=["run_id", "process_instance_id", "expected", "found"])

    kept = events.where("damage is null").select("run_id", "process_instance_id", "event_seq")
    return kept.groupBy("run_id", "process_instance_id").applyInPandasWithState(follow, "run_id string, process_instance_id string, expected long, found long", "last long", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> object:
    """Runs the stream over what is there, exactly once: a batch that is replayed overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each_batch(stream, put, checkpoint, mode)


def each_batch(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> object:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


#: Events that end a trace, and those whose first time a finished trace is given with.
ENDS = ("request_complete", "request_rejected", "request_cancel", "request_error")
TIMES = ("request_arrival", "prefill_http_submit", "prefill_http_complete", "p_to_d_route", "decode_first_byte")


def finished_traces(events: DataFrame) -> DataFrame:
    """(run_id, trace_id, terminal_event, terminal_mono_ns, a first time for each of TIMES) of each trace once it has ended.

    The state of a trace is one number for each of TIMES, and whether it has ended: a second end gives no row, and events
    may come in any order within and across batches as long as the end isn't the first to come in an earlier one.
    """
    importable(events.sparkSession)
    columns = ["run_id", "trace_id", "terminal_event", "terminal_mono_ns", *TIMES]

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *seen, over = state.get if state.exists else (*[-1] * len(TIMES), False)
        ends = []
        for p in parts:
            for kind, ts in zip(p["event_type"], p["ts_mono_ns"], strict=True):
                if kind in TIMES:
                    i = TIMES.index(kind)
                    seen[i] = int(ts) if seen[i] < 0 else min(seen[i], int(ts))
                elif kind in ENDS:
                    ends.append((int(ts), kind))
        rows = []
        if ends and not over:
            ts, kind = min(ends)
            rows.append((*key, kind, ts, *(None if x < 0 else x for x in seen)))
            over = True
        state.update((*seen, over))
        yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns[3:]})

    kept = events.where("damage is null and trace_id is not null").select("run_id", "trace_id", "event_type", "ts_mono_ns")
    out = "run_id string, trace_id string, terminal_event string, terminal_mono_ns long, " + ", ".join(f"{c} long" for c in TIMES)
    return kept.groupBy("run_id", "trace_id").applyInPandasWithState(follow, out, ", ".join(f"{c} long" for c in TIMES) + ", over boolean", "append", GroupStateTimeout.NoTimeout)


def completed(events: DataFrame, late: str = "10 seconds", grace_s: float = 10.0, idle_s: float = 3600.0) -> DataFrame:
    """(run_id, trace_id, value) of every event of each trace that is over, as JSON lines; a trace's lines come together, once.

    A trace is over once the watermark is ``grace_s`` beyond its last event if it has ended, ``idle_s`` if it hasn't; then its
    state goes. Its events may come in any order and in any batches until then. What comes for it afterwards is a trace of its own.
    """
    importable(events.sparkSession)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            lines = list(state.get[0])
            state.remove()
            yield pd.DataFrame({"run_id": key[0], "trace_id": key[1], "value": lines})
            return
        lines, last, ended = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, False)
        for p in parts:
            lines += p["value"].tolist()
            last = max(last, int(p["ts_wall_ns"].max()) // 1_000_000)
            ended = ended or bool(p["event_type"].isin(ENDS).any())
        state.update((lines, last, ended))
        state.setTimeoutTimestamp(max(last + int(1000 * (grace_s if ended else idle_s)), state.getCurrentWatermarkMs() + 1))

    ts = F.timestamp_micros(F.call_function("div", F.col("ts_wall_ns"), F.lit(1000).cast("long")))
    names = [f.split()[0] for f in ENVELOPE.split(", ")]
    rows = events.where("damage is null").withColumn("_ts", ts).withWatermark("_ts", late)
    # the time is in the condition so that events without a trace move the watermark too
    rows = rows.where(F.when(F.col("_ts").isNotNull(), F.col("trace_id")).isNotNull()).select("run_id", "trace_id", "_ts", "ts_wall_ns", "event_type", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
    return rows.groupBy("run_id", "trace_id").applyInPandasWithState(follow, "run_id string, trace_id string, value string", "lines array<string>, last long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def lifecycles(stream: DataFrame, path: str, checkpoint: str) -> object:
    """Writes attempts, traces and violations of completed() traces under path, by the batch operators; a batch that is replayed overwrites its own folders."""

    def put(batch: DataFrame, number: int) -> None:
        found = event_rows(batch.select("value")).where("damage is null").persist()
        for name, make in (("attempts", attempts), ("traces", traces), ("violations", lifecycle_violations)):
            make(found).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        found.unpersist()

    return each_batch(stream, put, checkpoint)
