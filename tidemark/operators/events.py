"""Rules on the event log: sequences, counters, lifecycles of traces and attempts, associations.

Every rule gives rows (run_id, code, key, detail); a rule without violations gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
TERMINALS = ("request_complete", "request_rejected", "request_cancel", "request_error")
ORDERED = (
    ("prefill_http_complete", "prefill_http_submit", "prefill_complete_without_submit"), ("p_to_d_route", "prefill_http_complete", "route_without_prefill_complete"),
    ("decode_http_submit", "p_to_d_route", "decode_submit_without_route"), ("decode_first_byte", "decode_http_submit", "first_byte_without_decode_submit"),
)
#: Events of which an attempt counts the last one; of all others the first.
LAST = ("prefill_http_complete", "p_to_d_route", "decode_http_submit")


def violations(df: DataFrame, code: Column | str, key: Column, detail: Column, run: str = "run_id") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(F.col(run).cast("string").alias("run_id"), code.alias("code"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def sequence_gaps(events: DataFrame, keys: list[str] = ("run_id", "process"), seq: str = "seq") -> DataFrame:
    """(keys, last, n, missing, duplicates) of each process: sequences start at 1 and have each number once."""
    g = events.groupBy(*keys).agg(F.max(seq).alias("last"), F.count(seq).alias("n"), F.countDistinct(seq).alias("_d"))
    return g.select(*keys, "last", "n", (F.col("last") - F.col("_d")).alias("missing"), (F.col("n") - F.col("_d")).alias("duplicates"))


def sequence_jumps(events: DataFrame, keys: list[str] = ("run_id", "process"), order: list[str] = ("seq",), seq: str = "seq") -> DataFrame:
    """(keys, seq, expected) of each event that doesn't follow its predecessor by one."""
    before = F.coalesce(F.lag(seq).over(W.partitionBy(*keys).orderBy(*order)), F.lit(0))
    return events.withColumn("expected", before + 1).where(F.col(seq) != F.col("expected")).select(*keys, seq, "expected")


def counter_totals(summaries: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Sums of all counters, and ``balanced``: as many events written as enqueued, none dropped."""
    g = summaries.groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters))
    return g.withColumn("balanced", F.col("enqueued") == F.col("written"))


def _one(kind: str, what: Column, last: bool) -> Column:
    of = F.when(F.col("event_type") == kind, F.struct("ts_mono_ns", "event_seq", what.alias("x")))
    return (F.max(of) if last else F.min(of))["x"]


def attempts(events: DataFrame) -> DataFrame:
    """A row for each (run_id, trace_id, attempt_id): times and payload fields of its first or last events, counts."""
    wall = F.struct("ts_mono_ns", "ts_wall_ns", "payload")
    kinds = ("prefill_http_submit", "prefill_http_complete", "p_to_d_route", "decode_http_submit", "decode_first_byte", "attempt_recomputed")
    end = F.when(F.col("event_type").isin(*TERMINALS), F.struct("ts_mono_ns", "event_seq", "event_type"))
    g = events.where("trace_id is not null and attempt_id is not null").groupBy("run_id", "trace_id", "attempt_id").agg(
        *(_one(k, wall, k in LAST).alias(k) for k in kinds), F.min(end).alias("_end"), F.collect_set("request_id").alias("request_ids"),
        F.min(F.struct("ts_mono_ns", "event_seq", "external_request_id", "process_instance_id")).alias("_first"), F.min("ts_mono_ns").alias("attempt_start_mono_ns"), F.max("ts_mono_ns").alias("attempt_end_mono_ns"),
        F.count_if(F.col("event_type") == "decode_stream_chunk").alias("decode_stream_chunks"), F.count_if(F.col("event_type") == "backend_retry").alias("backend_retries"), F.count("*").alias("event_count"),
    )
    field = lambda k, path: F.get_json_object(F.col(k)["payload"], f"$.{path}")
    return g.select(
        "run_id", "trace_id", "attempt_id", "request_ids", F.when(F.size("request_ids") == 1, F.col("request_ids")[0]).alias("request_id"), F.col("_first.external_request_id"), F.col("_first.process_instance_id"),
        *(F.col(k)[c].alias(f"{n}_{c[3:]}") for k, n in (("prefill_http_submit", "prefill_submit"), ("prefill_http_complete", "prefill_complete"), ("p_to_d_route", "route"), ("decode_http_submit", "decode_submit"), ("decode_first_byte", "decode_first_byte"), ("attempt_recomputed", "recomputed")) for c in ("ts_mono_ns", "ts_wall_ns")),
        field("prefill_http_submit", "backend_endpoint").alias("prefill_backend"), field("prefill_http_complete", "duration_ns").cast("long").alias("prefill_duration_ns"), field("p_to_d_route", "selected_decoder").alias("decoder_backend"),
        field("p_to_d_route", "route_reason").alias("route_reason"), field("attempt_recomputed", "previous_attempt_id").cast("int").alias("recomputed_from_attempt_id"), field("attempt_recomputed", "new_attempt_id").cast("int").alias("_new_attempt"),
        F.col("_end.event_type").alias("terminal_event"), F.col("_end.ts_mono_ns").alias("terminal_mono_ns"), "decode_stream_chunks", "backend_retries", "attempt_start_mono_ns", "attempt_end_mono_ns", "event_count",
    )


def traces(events: DataFrame) -> DataFrame:
    """A row for each (run_id, trace_id): arrival, admission, the terminal event if there is just one, counts."""
    kind = F.col("event_type")
    end = F.when(kind.isin(*TERMINALS), F.struct("ts_mono_ns", "event_seq", "event_type", "ts_wall_ns"))
    g = events.where("trace_id is not null").groupBy("run_id", "trace_id").agg(
        _one("request_arrival", F.struct("ts_mono_ns", "ts_wall_ns", "payload"), False).alias("_a"), F.count_if(kind == "request_arrival").alias("arrivals"), F.count_if(kind.isin(*TERMINALS)).alias("terminals"), F.min(end).alias("_e"),
        F.coalesce(F.bool_or(F.when(kind == "admission_decision", F.get_json_object("payload", "$.accepted") == "true")), F.lit(False)).alias("accepted"),
        F.count_if(kind == "request_rejected").alias("rejections"), F.count_if(kind == "prefill_http_submit").alias("submits"), F.collect_set("attempt_id").alias("attempt_ids"), F.count("*").alias("event_count"),
    )
    one = F.col("terminals") == 1
    return g.select(
        "run_id", "trace_id", F.col("_a.ts_wall_ns").alias("arrival_wall_ns"), F.col("_a.ts_mono_ns").alias("arrival_mono_ns"), F.get_json_object("_a.payload", "$.input_tokens").cast("long").alias("input_tokens"),
        F.get_json_object("_a.payload", "$.expected_output_tokens").cast("long").alias("expected_output_tokens"), "accepted", "arrivals", "terminals", "rejections", "submits", "attempt_ids",
        F.when(one, F.col("_e.event_type")).alias("terminal_event"), F.when(one, F.col("_e.ts_wall_ns")).alias("terminal_wall_ns"), F.when(one, F.col("_e.ts_mono_ns")).alias("terminal_mono_ns"), "event_count",
    )


def lifecycle_violations(events: DataFrame) -> DataFrame:
    """All rules on traces and attempts."""
    t, a = traces(events), attempts(events)
    of_trace = [
        ("arrival_missing", F.col("arrivals") == 0), ("duplicate_terminal_event", F.col("terminals") > 1), ("terminal_event_missing", F.col("terminals") == 0),
        ("accepted_request_without_terminal_state", F.col("accepted") & (F.col("terminals") == 0)), ("rejected_request_with_prefill_submit", (F.col("rejections") > 0) & (F.col("submits") > 0)),
        ("attempt_id_gap", (F.size("attempt_ids") > 0) & (F.array_max("attempt_ids") + 1 != F.size("attempt_ids"))),
    ]
    names = {"prefill_http_submit": "prefill_submit", "prefill_http_complete": "prefill_complete", "p_to_d_route": "route", "decode_http_submit": "decode_submit", "decode_first_byte": "decode_first_byte"}
    of_attempt = []
    for later, earlier, code in ORDERED:
        x, y = F.col(f"{names[later]}_mono_ns"), F.col(f"{names[earlier]}_mono_ns")
        of_attempt += [(code, x.isNotNull() & y.isNull()), ("event_order_violation", x < y)]
    first_byte, end = F.col("decode_first_byte_mono_ns"), F.col("terminal_mono_ns")
    of_attempt += [
        ("completion_before_first_byte", (F.col("terminal_event") == "request_complete") & (first_byte.isNull() | (end < first_byte))), ("event_order_violation", F.size("request_ids") > 1),
        ("trace_id_changed_after_recompute", F.col("recomputed_mono_ns").isNotNull() & ~F.col("_new_attempt").eqNullSafe(F.col("attempt_id"))),
    ]
    rules = lambda pairs: F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs))))
    key = F.concat_ws("/", "trace_id", F.col("attempt_id").cast("string"))
    reused = events.where("trace_id is not null and attempt_id is not null and request_id is not null").groupBy("run_id", "trace_id", "request_id").agg(F.countDistinct("attempt_id").alias("n")).where("n > 1")
    out = violations(t.select("run_id", "trace_id", rules(of_trace).alias("c")), F.col("c"), F.col("trace_id"), F.lit(None))
    out = out.unionByName(violations(a.select("run_id", "trace_id", "attempt_id", rules(of_attempt).alias("c")), F.col("c"), key, F.lit(None)))
    return out.unionByName(violations(reused, "request_id_reused_across_attempts", F.col("trace_id"), F.col("request_id")))


def canonical_ids(rows: DataFrame, known: DataFrame, raw: str, uuid: str) -> DataFrame:
    """rows with ``canonical``: the known id that equals the raw one, else the first UUID in it that is known, else the raw one.

    known: (id). The raw id's candidates meet the known ids in one equi-join.
    """
    found = F.concat(F.array(F.col(raw)), F.regexp_extract_all(F.col(raw), F.lit(f"({uuid})"), F.lit(1)))
    raws = rows.select(raw).distinct().select(raw, F.posexplode(found).alias("_p", "_c"))
    best = raws.join(known.select(F.col("id").alias("_c")).distinct(), "_c").groupBy(raw).agg(F.min_by("_c", "_p").alias("_best"))
    return rows.join(best, raw, "left").withColumn("canonical", F.coalesce("_best", raw)).drop("_best")
