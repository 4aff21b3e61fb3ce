"""Queries over the event log, lifecycles, joins, transfers and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import DAY_NS, UUID, boundary_at_or_after, ratio, window_index
from tidemark.operators import engine, events, states, stats, time
from tidemark.plans.registry import Tables, query
from tidemark.plans.windows import AT, BOUNDS, WEEK, bounds, last_boundary, weekly
from tidemark.sources import logs, sinks

DAMAGE = "event_id % 97 <> 0"  # leaves gaps in the sequences


def log(t: Tables) -> DataFrame:
    """The event log with gaps, and with every 101st event twice."""
    kept = t.ev.where(DAMAGE)
    return kept.unionByName(kept.where("event_id % 101 = 0"))


_LOG = f"kept AS (SELECT * FROM ev WHERE {DAMAGE}), lg AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE event_id % 101 = 0)"
#: Telemetry of requests: events of a trace with the kinds of the proxy, made of the event table's types.
_KINDS = {"view": "request_arrival", "click": "prefill_http_submit", "purchase": "prefill_http_complete", "signup": "decode_first_byte", "error": "request_complete"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END"
_PROXY = f"px AS (SELECT run_id, 't' || (process * 50 + k // 10) AS trace_id, k % 3 AS attempt_id, 'r' || (process * 50 + k % 7) AS request_id, {_KIND_SQL} AS kind, ts_ns, seq, value, k FROM ev)"


def proxy(t: Tables) -> DataFrame:
    """The event table as proxy events with the full envelope."""
    return t.ev.selectExpr(
        "run_id", "concat('t', process * 50 + k div 10) AS trace_id", "cast(k % 3 AS int) AS attempt_id", "concat('r', process * 50 + k % 7) AS request_id", "concat('x', k) AS external_request_id", "cast(process AS string) AS process_instance_id",
        f"{_KIND_SQL} AS event_type", "ts_ns AS ts_mono_ns", "ts_ns AS ts_wall_ns", "seq AS event_seq",
        "concat('{\"input_tokens\": ', k, ', \"backend_endpoint\": \"p', k % 4, '\", \"duration_ns\": ', cast(value * 100 AS bigint), '}') AS payload",
    )


@query("""x AS (SELECT *, process // 50 AS bucket, (seq - 1) // 1000000 AS part FROM ev)
SELECT bucket, part, row_number() OVER (PARTITION BY bucket, part ORDER BY process, seq) AS line, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 50 = 0 THEN 'not_json' END AS damage FROM x""")
def scan_files(t: Tables) -> DataFrame:
    """The log of each fifty processes, written to files of a million events of each and read back with damage, file and line."""
    good = F.to_json(F.struct("event_type", "ts_ns", "seq", "event_id", F.lit("{}").alias("payload")))
    rows = t.ev.select("process", "seq", F.expr("process div 50").alias("bucket"), F.expr("(seq - 1) div 1000000").alias("part"), F.when(F.col("event_id") % 50 == 0, F.lit("{bad")).otherwise(good).alias("value"))
    path = sinks.scratch(t.spark, "log")
    rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "process", "seq").select("bucket", "part", "value").write.partitionBy("bucket", "part").text(path)
    lines = logs.numbered(t.spark, path).withColumnRenamed("line", "_line")
    place = lambda name: F.regexp_extract("source_file", f"/{name}=([0-9]+)/", 1).cast("long").alias(name)
    found = logs.validated(lines.select("value", place("bucket"), place("part"), "_line"), "event_type string, ts_ns bigint, seq bigint, event_id bigint, payload string")
    return found.select("bucket", "part", F.col("_line").alias("line"), "event_id", "damage")


@query("SELECT run_id, event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k, round(sum(value), 4) AS total FROM ev GROUP BY ALL")
def scan_events(t: Tables) -> DataFrame:
    lines = t.ev.select(F.to_json(F.struct("run_id", "event_type", "event_id", "ts_ns", "seq", "value", F.struct("k").alias("payload"))).alias("value"))
    good = logs.validated(lines, "run_id string, event_type string, event_id bigint, ts_ns bigint, seq bigint, value double, payload string").where("damage is null")
    return good.groupBy("run_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("payload", "$.k").cast("long")).alias("k"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT CASE WHEN event_id % 50 = 0 THEN 'not_json' WHEN event_id % 50 = 1 THEN 'field_missing' WHEN event_id % 50 = 2 THEN 'sequence_not_positive' WHEN event_id % 50 = 3 THEN 'payload_not_object' END AS damage, count(*) AS n
FROM ev WHERE event_id % 50 < 4 GROUP BY 1""")
def scan_damaged(t: Tables) -> DataFrame:
    whole = F.to_json(F.struct("run_id", "event_type", "event_id", "ts_ns", "value", "seq", F.struct("k").alias("payload")))
    m = F.col("event_id") % 50
    line = (
        F.when(m == 0, F.lit("{bad json}")).when(m == 1, F.to_json(F.struct("run_id", "event_id", "ts_ns", "value", "seq", F.struct("k").alias("payload"))))
        .when(m == 2, F.to_json(F.struct("run_id", "event_type", "event_id", "ts_ns", "value", F.lit(0).alias("seq"), F.struct("k").alias("payload"))))
        .when(m == 3, F.to_json(F.struct("run_id", "event_type", "event_id", "ts_ns", "value", "seq", F.lit("text").alias("payload")))).otherwise(whole)
    )
    read = logs.validated(t.ev.select(line.alias("value")), "run_id string, event_type string, event_id bigint, ts_ns bigint, seq bigint, value double, payload string")
    return read.where("damage is not null").groupBy("damage").agg(F.count("*").alias("n"))


@query(f"{_LOG} SELECT run_id, process, max(seq) AS last, count(*) AS n, max(seq) - count(DISTINCT seq) AS missing, count(*) - count(DISTINCT seq) AS duplicates FROM lg GROUP BY ALL")
def dq_seq_gap(t: Tables) -> DataFrame:
    return events.sequence_gaps(log(t))


@query(f"{_LOG}, x AS (SELECT run_id, process, seq, event_id, coalesce(lag(seq) OVER (PARTITION BY run_id, process ORDER BY seq, event_id), 0) + 1 AS expected FROM lg) SELECT run_id, process, seq, expected FROM x WHERE seq <> expected")
def dq_seq_gap_inspect(t: Tables) -> DataFrame:
    return events.sequence_jumps(log(t), order=("seq", "event_id"))


@query(f"""{_LOG}, s AS (SELECT run_id, process, count(*) AS enqueued FROM ev GROUP BY ALL), x AS (SELECT run_id, process, count(DISTINCT seq) AS written FROM lg GROUP BY ALL)
SELECT s.run_id, CAST(sum(enqueued) AS BIGINT) AS enqueued, CAST(sum(coalesce(written, 0)) AS BIGINT) AS written, sum(enqueued) = sum(coalesce(written, 0)) AS balanced FROM s LEFT JOIN x ON s.run_id = x.run_id AND s.process = x.process GROUP BY s.run_id""")
def dq_writer_counters(t: Tables) -> DataFrame:
    written = log(t).groupBy("run_id", "process").agg(F.countDistinct("seq").alias("written"))
    summaries = t.ev.groupBy("run_id", "process").agg(F.count("*").alias("enqueued")).join(written, ["run_id", "process"], "left")
    return events.counter_totals(summaries, ["run_id"], ["enqueued", "written"])


@query(f"""{_PROXY}
SELECT trace_id, attempt_id, min(ts_ns) FILTER (WHERE kind = 'prefill_http_submit') AS prefill_submit_mono_ns, max(ts_ns) FILTER (WHERE kind = 'prefill_http_complete') AS prefill_complete_mono_ns,
       min(ts_ns) FILTER (WHERE kind = 'decode_first_byte') AS decode_first_byte_mono_ns, CASE WHEN count(DISTINCT request_id) = 1 THEN min(request_id) END AS request_id,
       CASE WHEN count(*) FILTER (WHERE kind = 'request_complete') > 0 THEN 'request_complete' END AS terminal_event, min(ts_ns) AS attempt_start_mono_ns, max(ts_ns) AS attempt_end_mono_ns, count(*) AS event_count
FROM px GROUP BY trace_id, attempt_id""")
def lifecycle_attempt(t: Tables) -> DataFrame:
    names = ["trace_id", "attempt_id", "prefill_submit_mono_ns", "prefill_complete_mono_ns", "decode_first_byte_mono_ns", "request_id", "terminal_event", "attempt_start_mono_ns", "attempt_end_mono_ns", "event_count"]
    return events.attempts(proxy(t)).select(*names).withColumn("attempt_id", F.col("attempt_id").cast("long"))


@query(f"""{_PROXY}
SELECT trace_id, min(ts_ns) FILTER (WHERE kind = 'request_arrival') AS arrival_mono_ns, arg_min(k, struct_pack(a := ts_ns, b := seq)) FILTER (WHERE kind = 'request_arrival') AS input_tokens, count(*) FILTER (WHERE kind = 'request_arrival') AS arrivals,
       count(*) FILTER (WHERE kind = 'request_complete') AS terminals, CASE WHEN count(*) FILTER (WHERE kind = 'request_complete') = 1 THEN min(ts_ns) FILTER (WHERE kind = 'request_complete') END AS terminal_mono_ns, count(*) AS event_count
FROM px GROUP BY trace_id""")
def lifecycle_trace(t: Tables) -> DataFrame:
    return events.traces(proxy(t)).select("trace_id", "arrival_mono_ns", "input_tokens", "arrivals", "terminals", "terminal_mono_ns", "event_count")


@query(f"""{_PROXY},
tr AS (SELECT trace_id, count(*) FILTER (WHERE kind = 'request_arrival') AS a, count(*) FILTER (WHERE kind = 'request_complete') AS e, max(attempt_id) + 1 - count(DISTINCT attempt_id) AS g FROM px GROUP BY trace_id),
atm AS (SELECT trace_id, attempt_id, min(ts_ns) FILTER (WHERE kind = 'prefill_http_submit') AS s, max(ts_ns) FILTER (WHERE kind = 'prefill_http_complete') AS c, min(ts_ns) FILTER (WHERE kind = 'decode_first_byte') AS f,
       min(ts_ns) FILTER (WHERE kind = 'request_complete') AS e, count(DISTINCT request_id) AS r FROM px GROUP BY trace_id, attempt_id),
ru AS (SELECT trace_id, request_id FROM px GROUP BY ALL HAVING count(DISTINCT attempt_id) > 1),
v AS (SELECT 'arrival_missing' AS code FROM tr WHERE a = 0 UNION ALL SELECT 'duplicate_terminal_event' FROM tr WHERE e > 1 UNION ALL SELECT 'terminal_event_missing' FROM tr WHERE e = 0 UNION ALL SELECT 'attempt_id_gap' FROM tr WHERE g > 0
      UNION ALL SELECT 'prefill_complete_without_submit' FROM atm WHERE c IS NOT NULL AND s IS NULL UNION ALL SELECT 'event_order_violation' FROM atm WHERE c < s UNION ALL SELECT 'first_byte_without_decode_submit' FROM atm WHERE f IS NOT NULL
      UNION ALL SELECT 'completion_before_first_byte' FROM atm WHERE e IS NOT NULL AND (f IS NULL OR e < f) UNION ALL SELECT 'event_order_violation' FROM atm WHERE r > 1 UNION ALL SELECT 'request_id_reused_across_attempts' FROM ru)
SELECT code, count(*) AS n FROM v GROUP BY code""")
def dq_event_order(t: Tables) -> DataFrame:
    return events.lifecycle_violations(proxy(t)).groupBy("code").agg(F.count("*").alias("n"))


@query(f"""u AS (SELECT DISTINCT lpad(CAST(client AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000' AS id FROM att WHERE client % 3 <> 0),
e AS (SELECT request_id, lpad(CAST(client AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000' AS id FROM att)
SELECT e.request_id, CASE WHEN u.id IS NULL THEN 'cmpl-' || e.id || '-0-' || (e.request_id % 9) ELSE u.id END AS canonical FROM e LEFT JOIN u ON e.id = u.id""")
def uuid_canonicalize(t: Tables) -> DataFrame:
    id_ = F.concat(F.lpad(F.col("client").cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    rows = t.att.select("request_id", F.concat(F.lit("cmpl-"), id_, F.lit("-0-"), (F.col("request_id") % 9).cast("string")).alias("raw"))
    return events.canonical_ids(rows, t.att.where("client % 3 <> 0").select(id_.alias("id")), "raw", UUID).select("request_id", "canonical")


@query("SELECT event_id, k, CAST(NULL AS BIGINT) AS absent, event_type = 'error' AS failed FROM ev")
def project_payload(t: Tables) -> DataFrame:
    p = F.from_json("props", "k bigint, absent bigint")
    return t.ev.select("event_id", p["k"].alias("k"), p["absent"].alias("absent"), (F.col("event_type") == "error").alias("failed"))


@query("SELECT rank % 50 AS iteration_id, request_id, n AS scheduled FROM em WHERE n > 0")
def unnest_members(t: Tables) -> DataFrame:
    # batches of one iteration in one hundredth of the requests: a batch is a bounded list, as in the log
    batches = t.em.groupBy(F.expr("rank % 50").alias("iteration_id"), F.expr("request_id div 20").alias("part")).agg(F.collect_list(F.struct("request_id", F.col("n").alias("scheduled"))).alias("members"))
    return batches.select("iteration_id", F.explode("members").alias("m")).select("iteration_id", "m.request_id", "m.scheduled").where("scheduled > 0")


@query("SELECT 'metric_' || event_type AS name, round(sum(round(value, 2)), 2) AS total, count(*) AS n FROM ev GROUP BY 1")
def parse_prometheus(t: Tables) -> DataFrame:
    line = F.concat(F.lit("metric_"), "event_type", F.lit('{process="'), "process", F.lit('"} '), F.round("value", 2).cast("decimal(18,2)").cast("string"))
    text = t.ev.select(line.alias("value")).unionByName(t.ev.select(F.concat(F.lit("# HELP metric_"), "event_type").alias("value")).distinct())
    return logs.prometheus(text).groupBy("name").agg(F.round(F.sum("number"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT 'cmpl-' || process AS request, max(k) AS ms FROM ev WHERE k IS NOT NULL GROUP BY 1")
def parse_logs(t: Tables) -> DataFrame:
    line = F.concat(F.lit("INFO transfer of request cmpl-"), "process", F.lit(" rank "), F.col("k") % 4, F.lit(" took "), "k", F.lit(" ms"))
    found = logs.extracted(t.ev.select(line.alias("value")), r"request (\S+) rank (\d+) took (\d+) ms", ["request", "rank", "ms"])
    return found.groupBy("request").agg(F.max(F.col("ms").cast("long")).alias("ms"))


@query("SELECT a.request_id, a.trace_id, x.arrivals, x.first_ns FROM att a LEFT JOIN (SELECT trace_id, count(*) AS arrivals, min(arrival_ns) AS first_ns FROM att WHERE trace_id % 5 <> 0 GROUP BY trace_id) x ON a.trace_id = x.trace_id")
def join_attempt_trace(t: Tables) -> DataFrame:
    trace = t.att.where("trace_id % 5 <> 0").groupBy("trace_id").agg(F.count("*").alias("arrivals"), F.min("arrival_ns").alias("first_ns"))
    return t.att.select("request_id", "trace_id").join(trace, "trace_id", "left")


@query("""
x AS (SELECT request_id, min(ts_ns) FILTER (WHERE component = 'prefill') AS prefill_ns, max(ts_ns) FILTER (WHERE component <> 'prefill') AS decode_ns, arg_max(component, struct_pack(a := ts_ns, b := seq, c := component)) FILTER (WHERE component <> 'prefill') AS decode_component FROM em GROUP BY request_id)
SELECT a.request_id, prefill_ns, decode_ns, decode_component FROM att a LEFT JOIN x ON a.request_id = x.request_id""")
def join_engine_roles(t: Tables) -> DataFrame:
    decode = F.col("component") != "prefill"
    roles = t.em.groupBy("request_id").agg(F.min(F.when(~decode, F.col("ts_ns"))).alias("prefill_ns"), F.max(F.when(decode, F.struct("ts_ns", "seq", "component"))).alias("d"))
    return t.att.select("request_id").join(roles, "request_id", "left").select("request_id", "prefill_ns", F.col("d.ts_ns").alias("decode_ns"), F.col("d.component").alias("decode_component"))


@query("SELECT request_id, string_agg(seq || ':' || n, ',' ORDER BY ts_ns, seq, n) AS members, count(*) AS n FROM em WHERE request_id IN (SELECT request_id FROM att WHERE side = 0) GROUP BY request_id")
def join_semi_members(t: Tables) -> DataFrame:
    rows = t.em.join(t.att.where("side = 0").select("request_id"), "request_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("ts_ns", "seq", "n")))
    return rows.groupBy("request_id").agg(listed.alias("l")).select("request_id", F.array_join(F.transform("l", lambda x: F.concat(x["seq"], F.lit(":"), x["n"])), ",").alias("members"), F.size("l").cast("long").alias("n"))


@query("SELECT workload, component, count(*) AS n FROM em e JOIN att a ON e.request_id = a.request_id GROUP BY ALL")
def join_broadcast_attempts(t: Tables) -> DataFrame:
    # the index of attempts grows with the input: Spark broadcasts it below its size limit and sorts both sides beyond
    return t.em.join(t.att.select("request_id", "workload"), "request_id").groupBy("workload", "component").agg(F.count("*").alias("n"))


_LIFE = """adm AS (SELECT request_id, min(ts_ns) AS admission_ns FROM em WHERE component <> 'prefill' GROUP BY request_id),
lj AS (SELECT l.*, adm.admission_ns, CASE WHEN l.client % 7 = 0 THEN 'ignored_without_route' WHEN l.kv_ready_ns IS NULL THEN 'missing_kv_ready' WHEN adm.admission_ns IS NULL THEN 'missing_admission' WHEN l.terminal_ns IS NULL THEN 'missing_trace'
       WHEN NOT (l.kv_enqueue_ns <= l.kv_ready_ns AND l.kv_ready_ns <= adm.admission_ns AND adm.admission_ns <= l.terminal_ns) OR l.kv_enqueue_ns IS NULL THEN 'invalid_stage_order' ELSE 'complete' END AS reason
       FROM life l LEFT JOIN adm ON l.request_id = adm.request_id)"""


def lifecycles(t: Tables) -> DataFrame:
    """Requests with the time of their first decode membership, and why one can't be followed through its stages."""
    admission = t.em.where("component <> 'prefill'").groupBy("request_id").agg(F.min("ts_ns").alias("admission_ns"))
    ordered = (F.col("kv_enqueue_ns") <= F.col("kv_ready_ns")) & (F.col("kv_ready_ns") <= F.col("admission_ns")) & (F.col("admission_ns") <= F.col("terminal_ns"))
    reason = (
        F.when(F.col("client") % 7 == 0, "ignored_without_route").when(F.col("kv_ready_ns").isNull(), "missing_kv_ready").when(F.col("admission_ns").isNull(), "missing_admission").when(F.col("terminal_ns").isNull(), "missing_trace")
        .when(~F.coalesce(ordered, F.lit(False)), "invalid_stage_order").otherwise("complete")
    )
    return t.life.join(admission, "request_id", "left").withColumn("reason", reason)


@query(f"{_LIFE} SELECT reason, count(*) AS n, CAST(sum(expected_tokens) AS BIGINT) AS tokens FROM lj GROUP BY reason")
def lifecycle_join(t: Tables) -> DataFrame:
    return lifecycles(t).groupBy("reason").agg(F.count("*").alias("n"), F.sum("expected_tokens").alias("tokens"))


#: Stage times that always exist, for the three-stage inventory.
_STAGES = "st AS (SELECT request_id, side, expected_tokens, arrival_ns AS route_ns, arrival_ns + (2 + request_id % 9) * 86400000000000 AS ready_ns, arrival_ns + (12 + request_id % 15) * 86400000000000 AS admission_ns, arrival_ns + (40 + request_id % 60) * 86400000000000 AS terminal_ns FROM att)"


def staged(t: Tables) -> DataFrame:
    d = F.lit(DAY_NS)
    r = F.col("request_id")
    return t.att.select("request_id", "side", "expected_tokens", F.col("arrival_ns").alias("route_ns"), (F.col("arrival_ns") + (2 + r % 9) * d).alias("ready_ns"), (F.col("arrival_ns") + (12 + r % 15) * d).alias("admission_ns"), (F.col("arrival_ns") + (40 + r % 60) * d).alias("terminal_ns"))


@query(f"""{_STAGES}
SELECT CASE WHEN e.ts_ns >= route_ns AND e.ts_ns < ready_ns THEN 'handoff' WHEN e.ts_ns >= ready_ns AND e.ts_ns < admission_ns THEN 'waiting' WHEN e.ts_ns >= admission_ns AND e.ts_ns < terminal_ns THEN 'running' END AS stage, count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens
FROM em e JOIN st ON e.request_id = st.request_id GROUP BY 1""")
def stage_of_event(t: Tables) -> DataFrame:
    return t.em.join(staged(t), "request_id").withColumn("stage", states.stage()).groupBy("stage").agg(F.count("*").alias("n"), F.sum("n").alias("tokens"))


_SPAN = {"handoff": ("route_ns", "ready_ns"), "waiting": ("ready_ns", "admission_ns"), "running": ("admission_ns", "terminal_ns")}


def stage_intervals(t: Tables) -> DataFrame:
    """(side, stage, start_ns, end_ns, expected_tokens): one row for each request and stage."""
    spans = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(a).alias("start_ns"), F.col(b).alias("end_ns")) for s, (a, b) in _SPAN.items()))
    return staged(t).select("request_id", "side", "expected_tokens", F.explode(spans).alias("x")).select("request_id", "side", "expected_tokens", "x.*")


@query(f"""{_STAGES}, i AS ({" UNION ALL ".join(f"SELECT side, '{s}' AS stage, ({a} + {WEEK - 1}) // {WEEK} AS a, ({b} + {WEEK - 1}) // {WEEK} AS b FROM st" for s, (a, b) in _SPAN.items())}),
d AS (SELECT side, stage, a AS k, 1 AS n FROM i WHERE a < b UNION ALL SELECT side, stage, b, -1 FROM i WHERE a < b), c AS (SELECT side, stage, k, sum(n) AS n FROM d GROUP BY ALL)
SELECT side, stage, k, CAST(sum(n) OVER (PARTITION BY side, stage ORDER BY k) AS BIGINT) AS n FROM c""")
def stage_inventory(t: Tables) -> DataFrame:
    return time.inventory(stage_intervals(t), ["side", "stage"], "start_ns", "end_ns", WEEK, {"n": F.lit(1).cast("long")})


def flows(t: Tables) -> DataFrame:
    """(side, flow, k, n): requests entering and leaving stages, by window."""
    times = F.array(*(F.struct(F.lit(n).alias("flow"), F.col(c).alias("ts")) for n, c in (("route", "route_ns"), ("kv_ready", "ready_ns"), ("admission", "admission_ns"), ("terminal", "terminal_ns"))))
    rows = staged(t).select("side", F.explode(times).alias("x"))
    # what happens on a boundary shows there: it belongs to the window that ends at that boundary
    return rows.groupBy("side", "x.flow", (-window_index(-F.col("x.ts"), WEEK)).alias("k")).agg(F.count("*").alias("n"))


_FLOWS = f"fl AS ({' UNION ALL '.join(f'''SELECT side, '{n}' AS flow, ({c} + {WEEK - 1}) // {WEEK} AS k FROM st''' for n, c in (('route', 'route_ns'), ('kv_ready', 'ready_ns'), ('admission', 'admission_ns'), ('terminal', 'terminal_ns')))})"


@query(f"{_STAGES}, {_FLOWS} SELECT side, flow, k, count(*) AS n FROM fl GROUP BY ALL")
def stage_flows(t: Tables) -> DataFrame:
    return flows(t)


_NET = {"handoff": {"route": 1, "kv_ready": -1}, "waiting": {"kv_ready": 1, "admission": -1}, "running": {"admission": 1, "terminal": -1}}


_MOVES = (("handoff", "route_ns", 1), ("handoff", "ready_ns", -1), ("waiting", "ready_ns", 1), ("waiting", "admission_ns", -1), ("running", "admission_ns", 1), ("running", "terminal_ns", -1))


@query(f"""{_STAGES}, fl AS ({" UNION ALL ".join(f"SELECT side, '{s}' AS stage, ({c} + {WEEK - 1}) // {WEEK} AS k, {v} AS d FROM st" for s, c, v in _MOVES)}),
iv AS ({" UNION ALL ".join(f"SELECT side, '{s}' AS stage, ({a} + {WEEK - 1}) // {WEEK} AS a, ({b} + {WEEK - 1}) // {WEEK} AS b FROM st" for s, (a, b) in _SPAN.items())}), g AS (SELECT DISTINCT side, stage, k FROM fl),
x AS (SELECT g.stage, (SELECT count(*) FROM iv WHERE iv.side = g.side AND iv.stage = g.stage AND a <= g.k AND g.k < b) AS actual, (SELECT sum(d) FROM fl WHERE fl.side = g.side AND fl.stage = g.stage AND fl.k <= g.k) AS predicted FROM g)
SELECT stage, CAST(count(*) FILTER (WHERE predicted <> actual) AS INTEGER) AS mismatches FROM x GROUP BY stage""")
def replay_check(t: Tables) -> DataFrame:
    """Where the running sum of a stage's flows isn't its inventory: nowhere, at any boundary where either changes."""
    f = flows(t).groupBy("side", "k").pivot("flow", ["route", "kv_ready", "admission", "terminal"]).sum("n").fillna(0)
    net = F.array(*(F.struct(F.lit(s).alias("stage"), sum((F.col(c) * v for c, v in x.items()), F.lit(0)).alias("d")) for s, x in _NET.items()))
    long = f.select("side", "k", F.explode(net).alias("x")).select("side", "k", "x.stage", "x.d")
    predicted = long.withColumn("p", F.sum("d").over(W.partitionBy("side", "stage").orderBy("k")))
    actual = stage_inventory(t).withColumnRenamed("n", "a")
    both = predicted.join(actual, ["side", "stage", "k"], "left").withColumn("a", F.coalesce("a", F.last("a", ignorenulls=True).over(W.partitionBy("side", "stage").orderBy("k")), F.lit(0)))
    return both.groupBy("stage").agg(F.count_if(F.col("p") != F.col("a")).cast("int").alias("mismatches"))


@query(f"""{_STAGES}, fl2 AS (SELECT side, ({'route_ns'} + {WEEK - 1}) // {WEEK} AS k, 1 AS i, 0 AS o FROM st UNION ALL SELECT side, (terminal_ns + {WEEK - 1}) // {WEEK}, 0, 1 FROM st)
SELECT k, CAST(sum(i) FILTER (WHERE side = 0) - sum(i) FILTER (WHERE side = 1) AS BIGINT) AS inflow, CAST(sum(o) FILTER (WHERE side = 0) - sum(o) FILTER (WHERE side = 1) AS BIGINT) AS outflow FROM fl2 GROUP BY k HAVING count(DISTINCT side) = 2""")
def outflows(t: Tables) -> DataFrame:
    sign = F.when(F.col("side") == 0, F.col("n")).otherwise(-F.col("n"))
    g = flows(t).where("flow in ('route', 'terminal')").groupBy("k").agg(F.sum(F.when(F.col("flow") == "route", sign).otherwise(0)).alias("inflow"), F.sum(F.when(F.col("flow") == "terminal", sign).otherwise(0)).alias("outflow"), F.countDistinct("side").alias("_s"))
    return g.where("_s = 2").drop("_s")


@query(f"""{_STAGES}, {BOUNDS}, b AS (SELECT unnest(generate_series(lo, hi)) AS k FROM bounds),
i AS (SELECT (route_ns + {WEEK - 1}) // {WEEK} AS a, (terminal_ns + {WEEK - 1}) // {WEEK} AS z FROM st),
q AS (SELECT b.k, count(i.a) AS n FROM b LEFT JOIN i ON i.a <= b.k AND b.k < i.z GROUP BY b.k),
f AS (SELECT b.k, (SELECT count(*) FROM i WHERE a = b.k) - (SELECT count(*) FROM i WHERE z = b.k) AS net FROM b),
r AS (SELECT q.k, q.n - lag(q.n) OVER (ORDER BY q.k) - f.net AS residual FROM q JOIN f ON q.k = f.k)
SELECT count(residual) AS windows, count(*) FILTER (WHERE residual = 0) AS exact, CAST(sum(abs(residual)) AS BIGINT) AS error FROM r""")
def conservation_audit(t: Tables) -> DataFrame:
    """Change of the active inventory against arrivals less departures, at all boundaries."""
    boundaries = bounds(t).select(F.explode(F.sequence("lo", "hi")).alias("k"))
    q = time.inventory(staged(t), [], "route_ns", "terminal_ns", WEEK, {"n": F.lit(1).cast("long")})
    net = flows(t).where("flow in ('route', 'terminal')").groupBy("k").agg(F.sum(F.when(F.col("flow") == "route", F.col("n")).otherwise(-F.col("n"))).alias("net"))
    w = W.orderBy("k")  # one row for each boundary
    rows = boundaries.join(q, "k", "left").join(net, "k", "left").select("k", F.coalesce(F.last("n", ignorenulls=True).over(w), F.lit(0)).alias("n"), F.coalesce("net", F.lit(0)).alias("net"))
    rows = rows.withColumn("residual", F.col("n") - F.lag("n").over(w) - F.col("net"))
    return rows.agg(F.count("residual").alias("windows"), F.count_if(F.col("residual") == 0).alias("exact"), F.sum(F.abs("residual")).alias("error"))


@query("""SELECT request_id, component, CASE WHEN count(*) FILTER (WHERE seq % 2 = 1) > 0 THEN min(ts_ns) FILTER (WHERE seq % 2 = 1) END AS added_ns, max(ts_ns) FILTER (WHERE seq % 2 = 0) AS terminal_ns,
       coalesce(arg_min(n, struct_pack(a := ts_ns, b := seq, c := n)) FILTER (WHERE seq % 2 = 1), arg_max(n, struct_pack(a := ts_ns, b := seq, c := n)) FILTER (WHERE seq % 2 = 0)) AS anchor_value, count(*) AS events FROM em GROUP BY ALL""")
def engine_requests(t: Tables) -> DataFrame:
    rows = t.em.select("request_id", "component", "ts_ns", "seq", F.col("n").alias("value"), F.when(F.col("seq") % 2 == 1, "added").otherwise("terminal").alias("event_type"))
    return engine.engine_requests(rows, ["request_id", "component"], ["ts_ns", "seq"])


def transfer_events(t: Tables) -> DataFrame:
    kind = F.expr("CASE seq % 4 WHEN 1 THEN 'enqueued' WHEN 2 THEN 'started' WHEN 3 THEN 'completed' ELSE 'failed' END")
    is_ = lambda k: F.when(kind == k, F.col("ts_ns"))
    return t.em.select("request_id", F.lit("decode").alias("component"), F.lit("d").alias("target"), F.expr("rank % 2").alias("tp_rank"), F.lit(2).alias("tp_size"), kind.alias("event_type"), is_("enqueued").alias("enqueue_ns"), is_("started").alias("start_ns"), is_("completed").alias("complete_ns"),
                       F.col("n").alias("blocks"), F.when(F.col("n") % 5 != 0, F.col("n") * 4096).alias("bytes"))


_RANKS = """ke AS (SELECT request_id, rank % 2 AS tp_rank, seq % 4 AS kind, ts_ns, n FROM em),
kr AS (SELECT request_id, tp_rank, min(ts_ns) FILTER (WHERE kind = 1) AS enqueue_ns, min(ts_ns) FILTER (WHERE kind = 2) AS first_start_ns, max(ts_ns) FILTER (WHERE kind = 3) AS last_complete_ns, max(n) AS blocks,
       CASE WHEN count(*) FILTER (WHERE kind = 3) > 0 THEN CAST(coalesce(sum(n * 4096) FILTER (WHERE kind = 3 AND n % 5 <> 0), 0) AS BIGINT) END AS bytes, count(*) FILTER (WHERE kind = 2) AS started, count(*) FILTER (WHERE kind = 3) AS completed, count(*) FILTER (WHERE kind = 0) AS failed,
       count(*) FILTER (WHERE kind = 3) > 0 AND count(*) FILTER (WHERE kind = 0) = 0 AND count(*) FILTER (WHERE kind = 2) = count(*) FILTER (WHERE kind = 3) AS success FROM ke GROUP BY request_id, tp_rank)"""


@query(f"{_RANKS} SELECT *, last_complete_ns - first_start_ns AS transfer_ns FROM kr")
def kv_rank(t: Tables) -> DataFrame:
    return engine.transfer_ranks(transfer_events(t)).drop("component", "target", "tp_size", "enqueued")


@query(f"""{_RANKS}
SELECT request_id, count(*) AS observed, count(*) FILTER (WHERE success) AS done, CASE WHEN count(*) FILTER (WHERE success) = 2 THEN max(last_complete_ns) END AS ready_ns, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CAST(sum(blocks) AS BIGINT) AS blocks,
       max(last_complete_ns) - min(first_start_ns) AS transfer_ns, count(*) FILTER (WHERE success) = 2 AS success FROM kr GROUP BY request_id""")
def kv_transfer(t: Tables) -> DataFrame:
    found = engine.transfers(engine.transfer_ranks(transfer_events(t)))
    return found.select("request_id", F.col("observed").cast("long").alias("observed"), F.col("done").cast("long").alias("done"), "ready_ns", "bytes", "blocks", "transfer_ns", "success")


@query(f"{_RANKS} SELECT count(*) AS ranks, count(DISTINCT request_id) AS requests, count(*) FILTER (WHERE success) AS succeeded, CAST(sum(bytes) AS BIGINT) AS bytes, round(quantile_cont(last_complete_ns - first_start_ns, 0.5) / 1e9, 3) AS p50_s, round(avg(blocks), 6) AS blocks FROM kr")
def kv_summary(t: Tables) -> DataFrame:
    r = engine.transfer_ranks(transfer_events(t))
    plain = r.agg(F.count("*").alias("ranks"), F.countDistinct("request_id").alias("requests"), F.count_if("success").alias("succeeded"), F.sum("bytes").alias("bytes"), F.round(F.avg("blocks"), 6).alias("blocks"))
    p50 = stats.percentiles(r, [], "transfer_ns", {"p50": 0.5}).select(F.round(F.col("p50") / 1e9, 3).alias("p50_s"))
    return stats.joined_by(plain, p50, [])


@query("""it AS (SELECT rank AS iteration_id, component, sum(n) AS total, count(*) AS members FROM em GROUP BY ALL), mm AS (SELECT rank AS iteration_id, component, sum(n) AS s, count(*) AS c FROM em WHERE request_id % 40 <> 0 GROUP BY ALL)
SELECT it.iteration_id, it.component, CAST(total AS BIGINT) AS total, CAST(coalesce(s, 0) AS BIGINT) AS found, members, coalesce(c, 0) AS found_members FROM it LEFT JOIN mm ON it.iteration_id = mm.iteration_id AND it.component = mm.component WHERE total <> coalesce(s, 0) OR members <> coalesce(c, 0)""")
def dq_membership_sum(t: Tables) -> DataFrame:
    key = [F.col("rank").alias("iteration_id"), "component"]
    iterations = t.em.groupBy(*key).agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    found = t.em.where("request_id % 40 <> 0").groupBy(*key).agg(F.sum("n").alias("found"), F.count("*").alias("found_members"))
    return iterations.join(found, ["iteration_id", "component"], "left").fillna(0, ["found", "found_members"]).where("total <> found or members <> found_members")


@query("SELECT request_id, trace_id FROM life WHERE accepted AND request_id NOT IN (SELECT request_id FROM em WHERE component = 'prefill')")
def dq_missing_engine(t: Tables) -> DataFrame:
    return t.life.where("accepted").select("request_id", "trace_id").join(t.em.where("component = 'prefill'").select("request_id"), "request_id", "left_anti")


@query("SELECT client AS id, 'only_left' AS side FROM (SELECT DISTINCT client FROM att WHERE client % 9 <> 0 EXCEPT SELECT DISTINCT client FROM att WHERE client % 8 <> 0) UNION ALL SELECT client, 'only_right' FROM (SELECT DISTINCT client FROM att WHERE client % 8 <> 0 EXCEPT SELECT DISTINCT client FROM att WHERE client % 9 <> 0)")
def dq_run_set_equal(t: Tables) -> DataFrame:
    left, right = t.att.where("client % 9 <> 0").select(F.col("client").alias("id")), t.att.where("client % 8 <> 0").select(F.col("client").alias("id"))
    return left.subtract(right).withColumn("side", F.lit("only_left")).unionByName(right.subtract(left).withColumn("side", F.lit("only_right")))


@query("SELECT client AS run, count(DISTINCT workload) AS splits FROM att GROUP BY client HAVING count(DISTINCT workload) > 1")
def dq_run_isolation(t: Tables) -> DataFrame:
    return t.att.groupBy(F.col("client").alias("run")).agg(F.countDistinct("workload").alias("splits")).where("splits > 1")


@query(f"""{AT}, o AS (SELECT request_id, k, CASE state WHEN 'ADMITTED' THEN 1 WHEN 'PREFILL_WAITING' THEN 2 WHEN 'PREFILL_RUNNING' THEN 3 WHEN 'HANDOFF_WAITING' THEN 4 WHEN 'KV_QUEUED' THEN 5 WHEN 'KV_TRANSFERRING' THEN 6 WHEN 'KV_READY' THEN 7 WHEN 'DECODE_WAITING' THEN 8 ELSE 9 END AS r FROM s),
p AS (SELECT request_id, r, lag(r) OVER (PARTITION BY request_id ORDER BY k) AS b FROM o)
SELECT count(*) AS n, count(*) FILTER (WHERE r < b) AS backward FROM p""")
def dq_state_monotone(t: Tables) -> DataFrame:
    rank = F.element_at(F.create_map(*(x for s, r in states.RANKS.items() for x in (F.lit(s), F.lit(r)))), F.col("state"))
    first = boundary_at_or_after("start_ns", WEEK)
    after = F.coalesce(boundary_at_or_after("end_ns", WEEK), F.lit(last_boundary(t)) + 1)
    # a state counts at so many boundaries; only where one gives way to the next can the order fail
    seen = states.intervals(t.life).select("request_id", rank.alias("r"), first.alias("a"), (after - first).alias("m")).where("m > 0")
    back = F.col("r") < F.lag("r").over(W.partitionBy("request_id").orderBy("a"))
    return seen.withColumn("back", back).agg(F.sum("m").alias("n"), F.count_if("back").alias("backward"))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n FROM att WHERE client % 4 = 0 GROUP BY ALL)
SELECT run, k, b + 1 AS expected FROM (SELECT run, k, lag(k) OVER (PARTITION BY run ORDER BY k) AS b FROM wk) z WHERE k <> b + 1""")
def dq_window_contiguity(t: Tables) -> DataFrame:
    rows = t.att.where("client % 4 = 0").select("run", window_index("arrival_ns", WEEK).alias("k")).distinct()
    return rows.withColumn("expected", F.lag("k").over(W.partitionBy("run").orderBy("k")) + 1).where("k <> expected")


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n FROM att GROUP BY ALL), v AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS m FROM att WHERE request_id % 500 <> 0 GROUP BY ALL)
SELECT wk.run, count(*) AS windows, count(*) FILTER (WHERE m IS NULL) AS unmatched, count(*) FILTER (WHERE abs(n - coalesce(m, 0)) > 1e-12) AS different FROM wk LEFT JOIN v ON wk.run = v.run AND wk.k = v.k GROUP BY wk.run""")
def dq_forcing_align(t: Tables) -> DataFrame:
    side = t.att.where("request_id % 500 <> 0").groupBy("run", window_index("arrival_ns", WEEK).alias("w")).agg(F.count("*").alias("m")).withColumnRenamed("w", "k")
    return weekly(t).join(side, ["run", "k"], "left").groupBy("run").agg(F.count("*").alias("windows"), F.count_if(F.col("m").isNull()).alias("unmatched"), F.count_if(F.abs(F.col("n") - F.coalesce("m", F.lit(0))) > 1e-12).alias("different"))


@query("""x AS (SELECT request_id, component, n, sum(n) OVER (PARTITION BY request_id, component ORDER BY ts_ns, seq, n ROWS UNBOUNDED PRECEDING) AS after FROM em), y AS (SELECT request_id, component, after - n AS before, n, CASE WHEN request_id % 25 = 0 THEN after + 1 ELSE after END AS after FROM x)
SELECT request_id, component, count(*) AS iterations, CAST(sum(n) AS BIGINT) AS scheduled, CAST(max(after) AS BIGINT) AS final, bool_and(after = before + n) AND max(after) - min(before) = sum(n) AS exact FROM y GROUP BY ALL""")
def prefill_reconcile(t: Tables) -> DataFrame:
    w = W.partitionBy("request_id", "component").orderBy("ts_ns", "seq", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = t.em.withColumn("_a", F.sum("n").over(w)).select("request_id", "component", (F.col("_a") - F.col("n")).alias("before"), F.col("n").alias("scheduled"), F.when(F.col("request_id") % 25 == 0, F.col("_a") + 1).otherwise(F.col("_a")).alias("after"))
    top = rows.groupBy("request_id", "component").agg(F.max("after").alias("prompt"))
    found = engine.prefill_exact(rows.join(top, ["request_id", "component"]).withColumn("handoff", F.lit(0)))
    return found.select("request_id", "component", "iterations", "scheduled", "final", "exact")


@query("""e AS (SELECT request_id, sum(n) AS engine FROM em WHERE component <> 'prefill' GROUP BY request_id)
SELECT a.request_id, a.expected_tokens AS proxy, CAST(coalesce(engine, 0) AS BIGINT) AS engine, CAST(coalesce(engine, 0) - a.expected_tokens AS BIGINT) AS delta FROM att a LEFT JOIN e ON a.request_id = e.request_id WHERE a.status = 'F'""")
def decode_reconcile(t: Tables) -> DataFrame:
    e = t.em.where("component <> 'prefill'").groupBy("request_id").agg(F.sum("n").alias("engine"))
    return t.att.where("status = 'F'").join(e, "request_id", "left").select("request_id", F.col("expected_tokens").alias("proxy"), F.coalesce("engine", F.lit(0)).alias("engine"), (F.coalesce("engine", F.lit(0)) - F.col("expected_tokens")).alias("delta"))


@query("SELECT run_id, process, arg_min(event_type, seq) AS first_type, min(ts_ns) AS first_ns, count(*) AS written, count(*) FILTER (WHERE event_id % 97 = 0) AS dropped FROM ev GROUP BY ALL")
def component_inventory(t: Tables) -> DataFrame:
    return t.ev.groupBy("run_id", "process").agg(F.min_by("event_type", "seq").alias("first_type"), F.min("ts_ns").alias("first_ns"), F.count("*").alias("written"), F.count_if(F.col("event_id") % 97 == 0).alias("dropped"))


@query("""p AS (SELECT DISTINCT request_id FROM em WHERE component = 'prefill'), d AS (SELECT request_id, count(DISTINCT component) AS c FROM em WHERE component <> 'prefill' GROUP BY request_id)
SELECT count(*) AS accepted, count(p.request_id) AS with_prefill, count(d.request_id) AS with_decode, count(*) FILTER (WHERE d.c > 1) AS with_two_decoders, count(*) FILTER (WHERE kv_ready_ns IS NULL) AS without_transfer
FROM life l LEFT JOIN p ON l.request_id = p.request_id LEFT JOIN d ON l.request_id = d.request_id WHERE accepted""")
def association(t: Tables) -> DataFrame:
    g = t.em.groupBy("request_id").agg(F.count_if(F.col("component") == "prefill").alias("p"), F.countDistinct(F.when(F.col("component") != "prefill", F.col("component"))).alias("c"))
    return t.life.where("accepted").join(g, "request_id", "left").agg(F.count("*").alias("accepted"), F.count_if(F.col("p") > 0).alias("with_prefill"), F.count_if(F.col("c") > 0).alias("with_decode"), F.count_if(F.col("c") > 1).alias("with_two_decoders"), F.count_if(F.col("kv_ready_ns").isNull()).alias("without_transfer"))


@query("SELECT process, max(k) - min(k) AS spread, arg_max(k, struct_pack(a := ts_ns, b := event_id)) - arg_min(k, struct_pack(a := ts_ns, b := event_id)) AS delta FROM ev GROUP BY process")
def counter_delta(t: Tables) -> DataFrame:
    order = F.struct("ts_ns", "event_id")
    return t.ev.groupBy("process").agg((F.max("k") - F.min("k")).alias("spread"), (F.max_by("k", order) - F.min_by("k", order)).alias("delta"))


@query("SELECT run, workload, count(*) AS requests, count(*) FILTER (WHERE status = 'F') AS finished, round(count(*) FILTER (WHERE status = 'F') / count(*), 9) AS success_ratio, round(avg(input_tokens), 6) AS input_tokens FROM att GROUP BY ALL")
def workload_summary(t: Tables) -> DataFrame:
    f = F.count_if(F.col("status") == "F")
    return t.att.groupBy("run", "workload").agg(F.count("*").alias("requests"), f.alias("finished"), F.round(ratio(f, F.count("*")), 9).alias("success_ratio"), F.round(F.avg("input_tokens"), 6).alias("input_tokens"))


@query("SELECT workload, run, round(quantile_cont(input_tokens, 0.5), 6) AS p50, round(quantile_cont(input_tokens, 0.9), 6) AS p90, round(quantile_cont(input_tokens, 0.99), 6) AS p99 FROM att GROUP BY ALL")
def workload_percentiles(t: Tables) -> DataFrame:
    found = stats.percentiles(t.att, ["workload", "run"], "input_tokens", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select("workload", "run", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")))


@query("SELECT w.workload, l.load, r.rate, 's' || s.seed AS seed FROM (SELECT DISTINCT workload FROM att) w, (SELECT unnest(generate_series(1, 4)) AS load) l, (SELECT unnest(['poisson', 'burst']) AS rate) r, (SELECT unnest(generate_series(1, 3)) AS seed) s")
def run_matrix(t: Tables) -> DataFrame:
    # factors of an experiment: a handful of values each, unfolded rather than joined
    return t.att.select("workload").distinct().select("workload", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("load")).select("*", F.explode(F.array(F.lit("poisson"), F.lit("burst"))).alias("rate")).select("*", F.explode(F.array(*(F.lit(f"s{i}") for i in (1, 2, 3)))).alias("seed"))
