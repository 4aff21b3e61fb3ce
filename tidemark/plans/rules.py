"""Queries of the rule families, over views of the supplied tables with damage put in on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import window_index
from tidemark.operators import control, engine, gates, internal, snapshots, time
from tidemark.plans.events import DAMAGE, log, stage_intervals, transfer_events
from tidemark.plans.registry import Tables, query
from tidemark.plans.windows import BOUNDS, WEEK, bounds

_ROUTE = "CASE client % 3 WHEN 0 THEN 'decode-0' WHEN 1 THEN 'decode-1' END"


def _attempts(t: Tables) -> DataFrame:
    return t.life.selectExpr("run AS run_id", "request_id", "prefill_complete_ns IS NOT NULL AS prefilled", f"{_ROUTE} AS decoder")


def _of_run(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(t.att.select("request_id", F.col("run").alias("run_id")), "request_id")


@query(f"""
a AS (SELECT run AS run_id, request_id, prefill_complete_ns IS NOT NULL AS prefilled, {_ROUTE} AS decoder FROM life),
e AS (SELECT DISTINCT request_id, component FROM em WHERE request_id % 40 <> 0),
x AS (SELECT a.*, (SELECT count(*) FROM e WHERE e.request_id = a.request_id AND component = 'prefill') AS p, (SELECT count(*) FROM e WHERE e.request_id = a.request_id AND component <> 'prefill') AS d,
      (SELECT min(component) FROM e WHERE e.request_id = a.request_id AND component <> 'prefill') AS c FROM a)
SELECT CAST(run_id AS VARCHAR) AS run_id, 'accepted_attempt_missing_prefill_engine' AS code, CAST(request_id AS VARCHAR) AS key FROM x WHERE prefilled AND p = 0
UNION ALL SELECT CAST(run_id AS VARCHAR), 'routed_attempt_decode_engine_cardinality', CAST(request_id AS VARCHAR) FROM x WHERE decoder IS NOT NULL AND d <> 1
UNION ALL SELECT CAST(run_id AS VARCHAR), 'proxy_route_worker_mismatch', CAST(request_id AS VARCHAR) FROM x WHERE decoder IS NOT NULL AND d = 1 AND c <> decoder""")
def dq_engine_rules(t: Tables) -> DataFrame:
    engines = t.em.where("request_id % 40 <> 0").select("request_id", "component").distinct()
    return internal.engine_rules(_attempts(t), engines).drop("detail")


_KV = """ke AS (SELECT request_id, rank % 2 AS tp_rank, seq % 4 AS kind, ts_ns, n FROM em),
kr AS (SELECT request_id, tp_rank, max(ts_ns) FILTER (WHERE kind = 3) AS last_ns, coalesce(sum(n * 4096) FILTER (WHERE kind = 3 AND n % 5 <> 0), 0) AS bytes, count(*) FILTER (WHERE kind = 2) AS started, count(*) FILTER (WHERE kind = 3) AS completed,
       count(*) FILTER (WHERE kind = 0) AS failed FROM ke GROUP BY request_id, tp_rank),
kt AS (SELECT request_id, count(*) FILTER (WHERE completed > 0 AND failed = 0 AND started = completed) AS done, max(last_ns) AS last_ns, sum(bytes) AS bytes FROM kr GROUP BY request_id)"""


def _transfers(t: Tables) -> DataFrame:
    found = engine.transfers(engine.transfer_ranks(transfer_events(t)))
    return _of_run(t, found.where("request_id % 37 <> 0").select("request_id", "success", "ready_ns", "bytes", "missing")).where("run_id <> 1995")


def _ranks(t: Tables) -> DataFrame:
    return engine.transfer_ranks(transfer_events(t)).withColumn("engine", F.expr("concat('decode-', request_id % 2)"))


@query(f"""{_KV},
a AS (SELECT run AS run_id, request_id, {_ROUTE} AS decoder FROM att), r AS (SELECT * FROM a WHERE decoder IS NOT NULL),
k AS (SELECT a.run_id, kt.* FROM kt JOIN a ON a.request_id = kt.request_id WHERE kt.request_id % 37 <> 0 AND run_id <> 1995),
x AS (SELECT r.*, k.request_id AS found, done, last_ns, bytes FROM r LEFT JOIN k ON k.request_id = r.request_id),
v AS (SELECT run_id, 'pd_attempt_kv_transfer_cardinality' AS code, request_id AS key FROM x WHERE found IS NULL
      UNION ALL SELECT run_id, 'pd_attempt_kv_transfer_failed', request_id FROM x WHERE found IS NOT NULL AND done < 2
      UNION ALL SELECT run_id, 'pd_attempt_kv_ready_missing', request_id FROM x WHERE found IS NOT NULL AND (done < 2 OR last_ns IS NULL)
      UNION ALL SELECT run_id, 'pd_attempt_kv_bytes_missing', request_id FROM x WHERE found IS NOT NULL AND bytes <= 0
      UNION ALL SELECT run_id, 'pd_attempt_kv_rank_missing', request_id FROM x WHERE found IS NOT NULL AND done < 2
      UNION ALL SELECT run_id, 'proxy_route_kv_worker_mismatch', request_id FROM x WHERE found IS NOT NULL AND decoder <> 'decode-' || (request_id % 2)
      UNION ALL SELECT DISTINCT run_id, 'kv_telemetry_missing_for_pd_run', NULL FROM r WHERE run_id NOT IN (SELECT run_id FROM k))
SELECT CAST(run_id AS VARCHAR) AS run_id, code, CAST(key AS VARCHAR) AS key FROM v""")
def dq_transfer_rules(t: Tables) -> DataFrame:
    return internal.transfer_rules(_attempts(t), _transfers(t), _ranks(t)).drop("detail")


@query(f"""{_KV}, x AS (SELECT a.run AS run_id, kr.* FROM kr JOIN att a ON a.request_id = kr.request_id)
SELECT CAST(run_id AS VARCHAR) AS run_id, 'kv_complete_without_start' AS code, CAST(request_id AS VARCHAR) AS key FROM x WHERE completed > 0 AND started = 0
UNION ALL SELECT CAST(run_id AS VARCHAR), 'kv_transfer_missing_terminal', CAST(request_id AS VARCHAR) FROM x WHERE started <> completed + failed""")
def dq_transfer_rank_rules(t: Tables) -> DataFrame:
    return internal.rank_rules(_of_run(t, _ranks(t))).drop("detail")


@query("""it AS (SELECT component AS run_id, rank AS i, sum(n) AS total, count(*) AS c FROM em GROUP BY ALL), mm AS (SELECT component AS run_id, rank AS i, sum(n) AS s, count(*) AS m FROM em WHERE request_id % 400 <> 0 GROUP BY ALL),
x AS (SELECT it.*, coalesce(s, 0) AS s, coalesce(m, 0) AS m FROM it LEFT JOIN mm ON it.run_id = mm.run_id AND it.i = mm.i)
SELECT run_id, 'membership_token_sum_mismatch' AS code, run_id || '/' || i AS key FROM x WHERE s <> total UNION ALL SELECT run_id, 'membership_count_mismatch', run_id || '/' || i FROM x WHERE m <> c""")
def dq_membership_rules(t: Tables) -> DataFrame:
    key = [F.col("component").alias("process"), F.col("rank").alias("iteration_id")]
    iterations = t.em.groupBy(*key).agg(F.sum("n").alias("total"), F.count("*").alias("count")).withColumn("run_id", F.col("process"))
    members = t.em.where("request_id % 400 <> 0").select(*key, F.col("n").alias("scheduled"))
    return internal.membership_rules(iterations, members).drop("detail")


@query("""x AS (SELECT request_id, component, n, sum(n) OVER (PARTITION BY request_id, component ORDER BY ts_ns, seq, n ROWS UNBOUNDED PRECEDING) AS after FROM em),
y AS (SELECT request_id, bool_and(after = (after - n) + n) AND request_id % 25 <> 0 AS exact FROM x WHERE component = 'prefill' GROUP BY request_id)
SELECT CAST(a.run AS VARCHAR) AS run_id, 'prefill_accounting_unproven' AS code, CAST(y.request_id AS VARCHAR) AS key FROM y JOIN att a ON a.request_id = y.request_id WHERE NOT exact""")
def dq_accounting_rules(t: Tables) -> DataFrame:
    w = W.partitionBy("request_id", "component").orderBy("ts_ns", "seq", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = t.em.where("component = 'prefill'").withColumn("_a", F.sum("n").over(w)).select("request_id", "component", (F.col("_a") - F.col("n")).alias("before"), F.col("n").alias("scheduled"), F.when(F.col("request_id") % 25 == 0, F.col("_a") + 1).otherwise(F.col("_a")).alias("after"))
    top = rows.groupBy("request_id", "component").agg(F.max("after").alias("prompt"))
    return internal.accounting_rules(_of_run(t, engine.prefill_exact(rows.join(top, ["request_id", "component"]).withColumn("handoff", F.lit(0))))).drop("detail")


@query(f"""kept AS (SELECT * FROM ev WHERE {DAMAGE}), lg AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE event_id % 101 = 0),
g AS (SELECT run_id, process, max(seq) - count(DISTINCT seq) AS missing, count(*) - count(DISTINCT seq) AS twice FROM lg GROUP BY ALL),
s AS (SELECT run_id, process, count(*) AS enqueued, count(*) FILTER (WHERE {DAMAGE}) AS written FROM ev GROUP BY ALL)
SELECT run_id, 'event_seq_gap' AS code, CAST(process AS VARCHAR) AS key FROM g WHERE missing > 0 OR twice > 0
UNION ALL SELECT run_id, 'writer_counter_mismatch', CAST(process AS VARCHAR) FROM s WHERE written <> enqueued
UNION ALL SELECT run_id, 'jsonl_damaged_line', 'p' || process || '.jsonl' FROM ev WHERE event_id % 500 = 0""")
def dq_log_rules(t: Tables) -> DataFrame:
    summaries = t.ev.groupBy("run_id", "process").agg(F.count("*").alias("enqueued"), F.count_if(F.expr(DAMAGE)).alias("written"))
    damaged = t.ev.where("event_id % 500 = 0").select("run_id", F.format_string("p%d.jsonl", "process").alias("file"), F.lit("not_json").alias("damage"))
    return internal.log_rules(log(t), summaries, damaged).drop("detail")


#: Windows of two runs, the sides: inventories by stage at each boundary, arrivals and departures, with damage in some windows.
_SNAP = f"""st AS (SELECT side, arrival_ns AS route_ns, arrival_ns + (2 + request_id % 9) * 86400000000000 AS ready_ns, arrival_ns + (12 + request_id % 15) * 86400000000000 AS admission_ns, arrival_ns + (40 + request_id % 60) * 86400000000000 AS terminal_ns FROM att),
{BOUNDS}, w AS (SELECT side, k FROM (SELECT DISTINCT side FROM att) s, (SELECT unnest(generate_series(lo, hi)) AS k FROM bounds) b),
iv AS (SELECT side, (route_ns + {WEEK - 1}) // {WEEK} AS r, (ready_ns + {WEEK - 1}) // {WEEK} AS y, (admission_ns + {WEEK - 1}) // {WEEK} AS m, (terminal_ns + {WEEK - 1}) // {WEEK} AS z FROM st),
q AS (SELECT w.side, w.k, count(*) FILTER (WHERE r <= w.k AND w.k < y) AS handoff, count(*) FILTER (WHERE y <= w.k AND w.k < m) AS waiting, count(*) FILTER (WHERE m <= w.k AND w.k < z) AS running,
      count(*) FILTER (WHERE r = w.k + 1) AS arrivals, count(*) FILTER (WHERE z = w.k + 1) AS done FROM w LEFT JOIN iv ON iv.side = w.side GROUP BY w.side, w.k),
n AS (SELECT *, handoff + waiting + running AS active FROM q),
sn AS (SELECT side AS run_id, k, k * {WEEK} + CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END AS start_ns, (k + 1) * {WEEK} AS end_ns, active, handoff + CASE WHEN k % 45 = 0 THEN 1 ELSE 0 END AS handoff, waiting, running, arrivals + CASE WHEN k % 60 = 0 THEN 2 ELSE 0 END AS arrivals, done,
       lead(active) OVER o AS active_next, lead(handoff) OVER o AS handoff_next, lead(waiting) OVER o AS waiting_next, lead(running) OVER o AS running_next, k % 70 = 0 AS negative, k % 90 = 0 AS nan, k % 80 = 0 AS shifted FROM n WINDOW o AS (PARTITION BY side ORDER BY k)),
s AS (SELECT * FROM sn WHERE k % 97 <> 0)"""


def _snapshot(t: Tables) -> DataFrame:
    """The same in Spark: (run_id, window_id, start_ns, end_ns, stages and their next values, arrivals, done, x, x_next)."""
    one = {"n": F.lit(1).cast("long")}
    grid = bounds(t).select(F.explode(F.sequence("lo", "hi")).alias("k"))
    sides = t.att.select("side").distinct()
    grid = sides.withColumn("_j", F.lit(0)).join(F.broadcast(grid.withColumn("_j", F.lit(0))), "_j").drop("_j")  # two runs, and the windows of one calendar
    spans = stage_intervals(t)
    last = bounds(t).first().hi or 0
    held = time.dense_inventory(spans, ["side", "stage"], "start_ns", "end_ns", WEEK, one, last)
    held = held.groupBy("side", "k").pivot("stage", ["handoff", "waiting", "running"]).agg(F.sum("n"))
    edge = lambda c: (-window_index(-F.col(c), WEEK) - 1).alias("k")
    arrivals = spans.where("stage = 'handoff'").groupBy("side", edge("start_ns")).agg(F.count("*").alias("arrivals"))
    done = spans.where("stage = 'running'").groupBy("side", edge("end_ns")).agg(F.count("*").alias("done"))
    names = ["handoff", "waiting", "running"]
    rows = grid.join(held, ["side", "k"], "left").join(arrivals, ["side", "k"], "left").join(done, ["side", "k"], "left").fillna(0).withColumn("active", sum((F.col(c) for c in names), F.lit(0)))
    w = W.partitionBy("side").orderBy("k")
    rows = rows.select("*", *(F.lead(c).over(w).alias(f"{c}_next") for c in ("active", *names)))
    d = lambda m, v: F.when(F.col("k") % m == 0, v).otherwise(0)
    x = F.array(F.when(F.col("k") % 90 == 0, float("nan")).when(F.col("k") % 70 == 0, -1.0).otherwise(F.col("active").cast("double")))
    after = F.array((F.col("active_next") + d(80, 1)).cast("double"))
    return rows.select(
        F.col("side").alias("run_id"), F.col("k").alias("window_id"), (F.col("k") * WEEK + d(50, 1)).alias("start_ns"), ((F.col("k") + 1) * WEEK).alias("end_ns"), "active", (F.col("handoff") + d(45, 1)).alias("handoff"), "waiting", "running",
        (F.col("arrivals") + d(60, 2)).alias("arrivals"), "done", "active_next", "handoff_next", "waiting_next", "running_next", x.alias("x"), after.alias("x_next"),
    ).where("window_id % 97 <> 0")


@query(f"""{_SNAP},
o AS (SELECT *, lag(k) OVER w AS before, lag(end_ns) OVER w AS before_end, lead(k) OVER w AS after, lead(active) OVER w AS found, lead(negative) OVER w AS neg2, lead(nan) OVER w AS nan2 FROM s WINDOW w AS (PARTITION BY run_id ORDER BY k)),
v AS (SELECT run_id, 'window_index_gap' AS code, k FROM o WHERE k <> before + 1
      UNION ALL SELECT run_id, 'window_coverage_gap', k FROM o WHERE start_ns <> before_end UNION ALL SELECT run_id, 'window_period_mismatch', k FROM o WHERE end_ns - start_ns <> {WEEK}
      UNION ALL SELECT run_id, 'numeric_nan', k FROM o WHERE nan UNION ALL SELECT run_id, 'numeric_negative', k FROM o WHERE negative AND NOT nan
      UNION ALL SELECT run_id, 'request_inventory_conservation', k FROM o WHERE found IS NOT NULL AND active + arrivals - done <> found
      UNION ALL SELECT run_id, 'stage_inventory_conservation', k FROM o WHERE handoff + waiting + running <> active OR handoff_next + waiting_next + running_next <> active_next)
SELECT CAST(run_id AS VARCHAR) AS run_id, code, CAST(k AS VARCHAR) AS key FROM v""")
def dq_snapshot_rules(t: Tables) -> DataFrame:
    s = _snapshot(t)
    parts = snapshots.all_of(
        snapshots.numbers(s, "x"), snapshots.contiguity(s, WEEK), snapshots.stock_flow(s, "active", ["arrivals"], ["done"]), snapshots.stages(s, "active", ["handoff", "waiting", "running"])
    )
    return parts.drop("detail")


@query(f"""{_SNAP}, x AS (SELECT run_id, k, CASE WHEN nan THEN NULL WHEN negative THEN -1 ELSE active END AS x, nan, active_next + CASE WHEN shifted THEN 1 ELSE 0 END AS nx FROM s),
o AS (SELECT *, lead(x) OVER w AS fx, lead(nan) OVER w AS fn, lead(k) OVER w AS fk FROM x WINDOW w AS (PARTITION BY run_id ORDER BY k))
SELECT CAST(run_id AS VARCHAR) AS run_id, 'next_state_shift_mismatch' AS code, CAST(k AS VARCHAR) AS key FROM o WHERE fk IS NOT NULL AND (fn OR fx <> nx)""")
def dq_shift_rule(t: Tables) -> DataFrame:
    return snapshots.shift(_snapshot(t)).drop("detail")


@query(f"""{_KV}, kv AS (SELECT request_id, max(last_ns) AS ready FROM kr GROUP BY request_id), en AS (SELECT request_id, min(ts_ns) FILTER (WHERE kind = 1) AS enqueue_ns, min(ts_ns) FILTER (WHERE kind = 2) AS start_ns FROM ke GROUP BY request_id),
x AS (SELECT a.run, kt.request_id, enqueue_ns, start_ns, CASE WHEN done = 2 THEN kt.last_ns END AS ready_ns, l.decode_added_ns AS byte_ns, done, bytes FROM kt JOIN att a ON a.request_id = kt.request_id JOIN life l ON l.request_id = kt.request_id JOIN en ON en.request_id = kt.request_id)
SELECT CAST(run AS VARCHAR) AS run_id, 'kv_lifecycle_violation' AS code, CAST(request_id AS VARCHAR) AS key,
       array_to_string(list_filter([CASE WHEN NOT coalesce(enqueue_ns <= start_ns AND start_ns <= ready_ns, FALSE) THEN 'time_order' END, CASE WHEN ready_ns > byte_ns THEN 'ready_after_decode_first_byte' END, CASE WHEN done <> 2 THEN 'rank_count' END,
                                    CASE WHEN done < 2 THEN 'missing_ranks' END, CASE WHEN bytes <= 0 THEN 'bytes' END, CASE WHEN done < 2 THEN 'failed' END], lambda r: r IS NOT NULL), ',') AS detail
FROM x WHERE NOT coalesce(enqueue_ns <= start_ns AND start_ns <= ready_ns, FALSE) OR ready_ns > byte_ns OR done <> 2 OR bytes <= 0""")
def dq_transfer_lifecycle_rule(t: Tables) -> DataFrame:
    ranks = engine.transfer_ranks(transfer_events(t))
    times = ranks.groupBy("request_id").agg(F.min("enqueue_ns").alias("enqueue_ns"), F.min("first_start_ns").alias("start_ns"))
    rows = engine.transfers(ranks).select("request_id", "ready_ns", "done", "expected", F.size("missing").alias("missing"), "bytes", "success").join(times, "request_id")
    rows = rows.join(t.life.select("request_id", F.col("run").alias("run_id"), F.col("decode_added_ns").alias("first_byte_ns")), "request_id")
    return snapshots.transfer_lifecycles(rows)


@query(f"""{_SNAP}, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE k % 30 = 0) AS other FROM s GROUP BY run_id), b AS (SELECT hi - lo + 1 AS wanted FROM bounds)
SELECT CAST(run_id AS VARCHAR) AS run_id, 'measurement_window_count_mismatch' AS code FROM c, b WHERE n <> wanted UNION ALL SELECT CAST(run_id AS VARCHAR), 'non_measurement_window_in_training_snapshot' FROM c WHERE other > 0
UNION ALL SELECT CAST(run_id AS VARCHAR), 'snapshot_row_count_mismatch' FROM c WHERE other > 0 UNION ALL SELECT CAST(run_id AS VARCHAR), 'valid_window_ratio_below_gate' FROM c WHERE 1 - other / n <= 0.99""")
def dq_measurement_rules(t: Tables) -> DataFrame:
    s = _snapshot(t).withColumn("segment", F.when(F.col("window_id") % 30 == 0, "warmup").otherwise("measurement")).withColumn("valid", F.col("segment") == "measurement")
    whole = bounds(t).select((F.col("lo") * WEEK).alias("start_ns"), ((F.col("hi") + 1) * WEEK).alias("end_ns"), F.lit(WEEK // 1_000_000).alias("period_ms"), F.lit(0).alias("_j"))
    runs = s.select("run_id").distinct().withColumn("_j", F.lit(0)).join(F.broadcast(whole), "_j").drop("_j")
    found = snapshots.all_of(snapshots.measurement(s, runs), snapshots.row_counts({"windows": s, "outputs": s.where("segment = 'measurement'")}), snapshots.valid_share(s))
    return found.select("run_id", "code")


_FILES = ("windows", "state", "outputs")


@query("""r AS (SELECT DISTINCT client AS run FROM att), f AS (SELECT unnest(['windows', 'state', 'outputs']) AS file), p AS (SELECT unnest(['internal', 'proxy']) AS report),
m AS (SELECT run, file, CASE WHEN run % 9 = 0 AND file = 'state' THEN 'changed' ELSE 'same' END AS now FROM r, f WHERE NOT (run % 7 = 0 AND file = 'outputs')),
v AS (SELECT run, 'derived_file_missing' AS code, file AS key FROM r, f WHERE run % 7 = 0 AND file = 'outputs' UNION ALL SELECT run, 'snapshot_manifest_mismatch', file FROM r, f WHERE (run % 7 = 0 AND file = 'outputs') OR (run % 9 = 0 AND file = 'state')
      UNION ALL SELECT run, 'quality_report_missing', 'proxy' FROM r WHERE run % 5 = 0 UNION ALL SELECT run, 'upstream_quality_violation', 'internal' FROM r WHERE run % 4 = 0
      UNION ALL SELECT run, 'writer_not_balanced', 'w' || run FROM r WHERE run % 6 = 0 OR run % 11 = 0)
SELECT CAST(run AS VARCHAR) AS run_id, code, key FROM v""")
def dq_run_file_rules(t: Tables) -> DataFrame:
    """Files, digests, earlier reports and writers of runs, one for each client."""
    runs = t.att.select(F.col("client").alias("run_id")).distinct()
    listed = runs.select("run_id", F.explode(F.array(*map(F.lit, _FILES))).alias("file"))
    sealed = listed.withColumn("sha256", F.sha2(F.concat("file", F.col("run_id").cast("string")), 256))
    found = sealed.where("not (run_id % 7 = 0 and file = 'outputs')").withColumn("sha256", F.when(F.expr("run_id % 9 = 0 and file = 'state'"), "changed").otherwise(F.col("sha256")))
    reports = runs.select("run_id", F.lit("internal").alias("report"), F.when(F.col("run_id") % 4 == 0, 3).otherwise(0).alias("violations")).unionByName(runs.where("run_id % 5 <> 0").select("run_id", F.lit("proxy").alias("report"), F.lit(0).alias("violations")))
    writers = runs.select("run_id", F.concat(F.lit("w"), "run_id").alias("file"), F.lit(10).alias("enqueued"), F.when(F.col("run_id") % 6 == 0, 9).otherwise(10).alias("written"), F.when(F.col("run_id") % 11 == 0, 1).otherwise(0).alias("lost"))
    parts = snapshots.all_of(snapshots.files(runs, found, list(_FILES)), snapshots.digests(sealed, found), snapshots.reports(runs, reports), snapshots.writers(writers))
    return parts.drop("detail")


#: Control windows of a run: weeks, with the level of a command that changes every seven weeks.
_CTRL = f"""cw AS (SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY k) AS i, CASE (k // 7) % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 ELSE CASE WHEN run % 3 = 0 THEN 0.5 ELSE 0.7 END END AS u, (k // 7) * 7 * {WEEK} + CASE WHEN run % 4 = 0 AND (k // 7) % 2 = 0 THEN {4 * WEEK} ELSE 0 END AS applied_ns,
       run || '-c' || (k // 7) AS command FROM (SELECT DISTINCT run, arrival_ns // {WEEK} AS k FROM att) z)"""


@query(f"""{_CTRL},
d AS (SELECT *, u - lag(u) OVER w AS d FROM cw WINDOW w AS (PARTITION BY run ORDER BY k)), m AS (SELECT run, applied_ns - lag(applied_ns) OVER (PARTITION BY run ORDER BY k) AS t FROM d WHERE abs(d) > 1e-12),
g AS (SELECT run, count(*) AS n, count(DISTINCT round(u, 6)) AS levels, var_pop(u) AS v, max(abs(d)) AS step, count(*) FILTER (WHERE abs(d) > 1e-12) AS moves, count(*) FILTER (WHERE k % 77 = 0) AS other FROM d GROUP BY run), t AS (SELECT run, min(t) AS dwell FROM m GROUP BY run),
v AS (SELECT run, 'fast_window_count' AS code FROM g WHERE n <> 53 UNION ALL SELECT run, 'u_not_from_actuator_applied' FROM g WHERE other > 0 UNION ALL SELECT run, 'control_levels_incomplete' FROM g WHERE levels < 3 UNION ALL SELECT run, 'control_variance_too_low' FROM g WHERE v < 0.02
      UNION ALL SELECT run, 'control_delta_violation' FROM g WHERE step > 0.2 + 1e-10 UNION ALL SELECT run, 'insufficient_control_transitions' FROM g WHERE moves < 7 UNION ALL SELECT g.run, 'actual_dwell_too_short' FROM g JOIN t ON g.run = t.run WHERE dwell < {6 * WEEK}
      UNION ALL SELECT DISTINCT run, 'u_without_actuator_event' FROM cw WHERE (k // 7) % 11 = 0
      UNION ALL SELECT DISTINCT run, 'control_generation_not_strictly_monotonic' FROM (SELECT run, c, CASE WHEN c % 13 = 0 THEN c - 2 ELSE c END AS g, lag(CASE WHEN c % 13 = 0 THEN c - 2 ELSE c END) OVER (PARTITION BY run ORDER BY a, command) AS b FROM (SELECT DISTINCT run, command, applied_ns AS a, k // 7 AS c FROM cw WHERE (k // 7) % 11 <> 0) y) z WHERE g <= b)
SELECT CAST(run AS VARCHAR) AS run_id, code FROM v""")
def dq_control_run_rules(t: Tables) -> DataFrame:
    c = F.expr("k div 7")
    u = F.when(c % 3 == 0, 0.3).when(c % 3 == 1, 0.5).when(F.col("run") % 3 == 0, 0.5).otherwise(0.7)
    at = c * 7 * WEEK + F.when((F.col("run") % 4 == 0) & (c % 2 == 0), 4 * WEEK).otherwise(0)
    rows = t.att.select("run", window_index("arrival_ns", WEEK).alias("k")).distinct().select(
        F.col("run").alias("run_id"), F.col("k").alias("window_id"), u.alias("u"), at.alias("applied_ns"), F.concat("run", F.lit("-c"), c).alias("command_id"), F.when(F.col("k") % 77 == 0, "manual").otherwise("actuator_applied").alias("source"), c.alias("c")
    )
    applied = rows.where("c % 11 <> 0").select("run_id", "command_id", "applied_ns", F.when(F.col("c") % 13 == 0, F.col("c") - 2).otherwise(F.col("c")).alias("generation")).distinct()
    return control.run_rules(rows, applied, 53, [0.3, 0.5, 0.7], 0.02, 0.2, 7, 6 * WEEK).select("run_id", "code")


@query("""x AS (SELECT run_id, event_type, seq, ts_ns, process, k, event_id FROM ev),
c AS (SELECT run_id, 'control_field_missing' AS code, CAST(seq AS VARCHAR) AS key FROM x WHERE event_type IN ('signup', 'error') AND event_id % 9 = 0),
a AS (SELECT run_id, process, arg_max(ts_ns + CASE WHEN process % 5 = 0 THEN 1000000000000000 ELSE 0 END, seq) AS applied FROM x WHERE event_type = 'signup' GROUP BY ALL),
r AS (SELECT run_id, process, arg_min(ts_ns, seq) AS first FROM x WHERE event_type = 'purchase' GROUP BY ALL),
f AS (SELECT a.run_id, 'first_effect_before_apply', CAST(a.process AS VARCHAR) FROM a LEFT JOIN r ON r.run_id = a.run_id AND r.process = a.process WHERE first IS NULL OR first < applied),
m AS (SELECT run_id, 'attempt_decoder_migration', process || '/' || (k % 3) FROM x WHERE event_type = 'purchase' GROUP BY run_id, process, k % 3 HAVING count(DISTINCT k % 2) <> 1)
SELECT * FROM c UNION ALL SELECT * FROM f UNION ALL SELECT * FROM m""")
def dq_control_smoke_rules(t: Tables) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'actuator_applied' WHEN 'error' THEN 'actuator_rejected' WHEN 'purchase' THEN 'p_to_d_route' ELSE event_type END")
    fields = F.when(F.col("event_id") % 9 == 0, F.array(F.lit("u"))).otherwise(F.array(F.lit("u"), F.lit("generation")))
    rows = t.ev.select(
        "run_id", kind.alias("event_type"), F.col("seq").alias("event_seq"), "ts_ns", F.col("process").alias("trace_id"), (F.col("k") % 3).alias("attempt_id"), (F.col("k") % 2).alias("decoder"), F.col("process").cast("string").alias("command_id"),
        (F.col("ts_ns") + F.when(F.col("process") % 5 == 0, F.lit(1_000_000_000_000_000)).otherwise(0)).alias("applied_ns"), fields.alias("fields"),
    )
    return control.smoke_rules(rows, ["u", "generation"], ["actuator_applied", "actuator_rejected"]).drop("detail")


_RUN_STATE = {"base_snapshot_invalid": "n % 3 = 0", "inventory_not_drained": "open > 0", "workload_error_present": "p > 0", "invalid_split": "run_id % 5 = 0", "topology_drift": "run_id % 11 = 0", "pod_uid_changed": "run_id % 13 = 0", "pod_restart_detected": "run_id % 17 = 0"}


@query(f"""r AS (SELECT client AS run_id, count(*) AS n, count(*) FILTER (WHERE status = 'O') AS open, count(*) FILTER (WHERE status = 'P') AS p FROM att GROUP BY client),
s AS (SELECT client AS run_id, count(DISTINCT arrival_ns // {25 * WEEK}) AS b, bool_or(input_tokens % 40 = 0) AS gone FROM att GROUP BY client), e AS (SELECT process AS run_id, bool_or(event_type = 'error' AND k % 5 = 0) AS rejected, bool_or(event_type = 'error' AND k % 7 = 0) AS fell, max(k) AS m, count(*) AS c FROM ev GROUP BY process),
v AS ({" UNION ALL ".join(f"SELECT run_id, '{c}' AS code FROM r WHERE {x}" for c, x in _RUN_STATE.items())}
      UNION ALL SELECT run_id, 'slow_window_count' FROM s WHERE b <> 9 UNION ALL SELECT run_id, 'slow_control_fields_missing' FROM s WHERE gone
      UNION ALL SELECT r.run_id, x.code FROM r JOIN e ON e.run_id = r.run_id, (SELECT unnest(['control_reject_present', 'safety_fallback_present', 'writer_drop_nonzero', 'writer_counter_mismatch', 'health_sample_failure']) AS code) x
                WHERE CASE x.code WHEN 'control_reject_present' THEN rejected WHEN 'safety_fallback_present' THEN fell WHEN 'writer_drop_nonzero' THEN c % 2 = 0 WHEN 'writer_counter_mismatch' THEN c % 3 = 0 ELSE m > 90 END)
SELECT CAST(run_id AS VARCHAR) AS run_id, code FROM v""")
def dq_control_state_rules(t: Tables) -> DataFrame:
    """Runs are clients: their orders tell drain, errors and slow windows, the events of the user with their number the rest."""
    r = F.col("run_id")
    runs = t.att.groupBy(F.col("client").alias("run_id")).agg((F.count("*") % 3 != 0).alias("base_valid"), (F.count_if(F.col("status") == "O") == 0).alias("drained"), F.count_if(F.col("status") == "P").alias("errors"))
    runs = runs.select("*", F.when(r % 5 == 0, "train").otherwise("held-out").alias("split"), F.when(r % 11 == 0, "2-2-4").otherwise("2-2-2").alias("topology"), F.lit("p").alias("pod_before"), F.when(r % 13 == 0, "q").otherwise("p").alias("pod_after"), F.lit(0).alias("restarts_before"), F.when(r % 17 == 0, 1).otherwise(0).alias("restarts_after"))
    slow = t.att.groupBy(F.col("client").alias("run_id"), window_index("arrival_ns", 25 * WEEK).alias("k")).agg((F.count_if(F.col("input_tokens") % 40 == 0) == 0).alias("complete"))
    kind = F.explode(F.array_compact(F.array(F.when(F.col("k") % 5 == 0, "actuator_rejected"), F.when(F.col("k") % 7 == 0, "actuator_safety_fallback"))))
    events = t.ev.where("event_type = 'error'").select(F.col("process").alias("run_id"), kind.alias("event_type"))
    c = t.ev.groupBy(F.col("process").alias("run_id")).agg(F.count("*").alias("n"))
    writers = c.select("run_id", F.col("n").alias("enqueued"), F.when(F.col("n") % 3 == 0, F.col("n") - 1).otherwise(F.col("n")).alias("written"), F.when(F.col("n") % 2 == 0, 2).otherwise(0).alias("dropped"))
    health = t.ev.select(F.col("process").alias("run_id"), F.when(F.col("k") > 90, 503).otherwise(200).alias("status"))
    return control.state_rules(runs, events, slow, writers, health, 9, "held-out", "2-2-2").select("run_id", "code")


_SIGNALS = ["input_tokens", "expected_tokens"]


def _effects(name: str, keys: str) -> str:
    """SQL: means and effects of the signals by keys, at sides 0 and 1."""
    of = "SELECT {keys}, '{s}' AS signal, avg({v}) FILTER (WHERE side = 0) AS low, avg({v}) FILTER (WHERE side = 1) AS high, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b, var_samp({v}) FILTER (WHERE side = 0) AS va, var_samp({v}) FILTER (WHERE side = 1) AS vb FROM att GROUP BY {keys}"
    parts = " UNION ALL ".join(of.format(keys=keys, s=s, v=v) for s, v in [("route", "client % 10"), *((x, x) for x in _SIGNALS)])
    return f"{name} AS (SELECT *, CASE WHEN a >= 2 AND b >= 2 THEN (high - low) / sqrt(nullif((a - 1) * va + (b - 1) * vb, 0) / (a + b - 2)) END AS effect FROM ({parts}) z)"


def _signals(t: Tables, keys: list[str]) -> DataFrame:
    of = {"route": F.col("client") % 10} | {s: F.col(s) for s in _SIGNALS}
    rows = t.att.select("workload", "run", "side", F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), c.cast("double").alias("v")) for n, c in of.items()))).alias("x")).select("workload", "run", "side", "x.*")
    return gates.responses(rows, [*keys, "signal"], "side", "v", 0, 1)


@query(f"""{_effects("f", "workload, run")}, r AS (SELECT workload, run, bool_or(coalesce(high > low AND effect >= 0.25, FALSE)) AS ok FROM f WHERE signal <> 'route' GROUP BY workload, run)
SELECT workload, count(*) AS runs, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE ok) >= 2 AS ok FROM r GROUP BY workload""")
def pilot_gate(t: Tables) -> DataFrame:
    """Working points are workloads, runs are years, control is the side that serves."""
    return gates.authority(_signals(t, ["workload", "run"]).where("signal <> 'route'"), ["workload"], "run")


@query(f"""{_effects("f", "workload, run")}, {_effects("kn", "workload")},
j AS (SELECT f.workload, f.run, f.signal, f.low, f.high, f.effect, kn.low AS l, kn.high AS h, 0.2 * abs(kn.high - kn.low) AS m FROM f LEFT JOIN kn ON kn.workload = f.workload AND kn.signal = f.signal)
SELECT workload, run, coalesce(bool_or(high > low) FILTER (WHERE signal = 'route'), FALSE) AS route_ok, coalesce(bool_or(high > low AND effect >= 0.25 AND l - m <= low AND high <= h + m) FILTER (WHERE signal <> 'route'), FALSE) AS state_ok FROM j GROUP BY workload, run""")
def heldout_interpolation(t: Tables) -> DataFrame:
    """Years of a workload against what is known of it over all years."""
    return gates.interpolated(_signals(t, ["workload", "run"]), _signals(t, ["workload"]), ["workload"], "run", "signal", "route")


@query("""l AS (SELECT workload, run, client % 4 AS level, avg(side) AS route, avg(input_tokens) AS a, avg(expected_tokens) AS b FROM att GROUP BY workload, run, client % 4),
c AS (SELECT workload, run, CASE WHEN stddev_pop(route) > 0 THEN corr(level, route) END AS route, greatest(corr(level, a), corr(level, b)) AS state FROM l GROUP BY workload, run)
SELECT workload, run, round(route, 6) AS route, round(state, 6) AS state, coalesce(route >= 0.7 AND state >= 0.5, FALSE) AS ok FROM c""")
def heldout_robustness(t: Tables) -> DataFrame:
    """Levels are clients modulo four; the routes are the mean side."""
    rows = t.att.groupBy("workload", "run", (F.col("client") % 4).alias("level")).agg(F.avg("side").alias("r"), *(F.avg(s).alias(s) for s in _SIGNALS))
    return gates.robust(rows, ["workload", "run"], "level", "r", _SIGNALS).select("workload", "run", F.round("route", 6).alias("route"), F.round("state", 6).alias("state"), "ok")
