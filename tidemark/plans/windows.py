"""Queries over windows, states, control signals and time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import DAY_NS, bin_equal, bin_irregular, boundary_after, boundary_at_or_after, phase_features, ratio, side_of, signed, window_index
from tidemark.operators import states, time
from tidemark.plans.registry import Tables, query

HOUR, WEEK = 3_600_000_000_000, 7 * DAY_NS
LENGTHS = [0, 250, 500, 1000, 1500, 2000, 2500, 3000, 4000, 5000]
_BIN = "CASE " + " ".join(f"WHEN {{x}} >= {a} AND {{x}} < {b} THEN {i}" for i, (a, b) in enumerate(zip(LENGTHS[:-1], LENGTHS[1:], strict=True))) + f" ELSE {len(LENGTHS) - 2} END"


def _bins(x: str) -> str:
    return _BIN.format(x=x)


@query(f"""
w AS (SELECT run, arrival_ns // {WEEK} AS k, {_bins("input_tokens")} AS b, * EXCLUDE (run) FROM life),
r AS (SELECT run, min(k) AS lo, max(k) AS hi FROM w GROUP BY run),
g AS (SELECT run, unnest(generate_series(lo, hi)) AS k FROM r),
a AS (SELECT run, k, count(*) AS arrivals, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE terminal_event = 'request_rejected') AS rejected,
      sum(input_tokens) AS prompt_tokens, sum(expected_tokens) AS output_tokens, {", ".join(f"count(*) FILTER (WHERE b = {i}) AS len_{i}" for i in range(len(LENGTHS) - 1))} FROM w GROUP BY run, k)
SELECT g.run, g.k, CAST(coalesce(arrivals, 0) AS BIGINT) AS arrivals, CAST(coalesce(accepted, 0) AS BIGINT) AS accepted, CAST(coalesce(rejected, 0) AS BIGINT) AS rejected,
       CAST(coalesce(prompt_tokens, 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(output_tokens, 0) AS BIGINT) AS output_tokens,
       {", ".join(f"CAST(coalesce(len_{i}, 0) AS BIGINT) AS len_{i}" for i in range(len(LENGTHS) - 1))}
FROM g LEFT JOIN a ON g.run = a.run AND g.k = a.k""")
def window_disturbance(t: Tables) -> DataFrame:
    rows = t.life.withColumn("k", window_index("arrival_ns", WEEK)).withColumn("b", bin_irregular("input_tokens", LENGTHS))
    sums = {
        "arrivals": F.count("*"), "accepted": F.count_if("accepted"), "rejected": F.count_if(F.col("terminal_event") == "request_rejected"),
        "prompt_tokens": F.sum("input_tokens"), "output_tokens": F.sum("expected_tokens"), **{f"len_{i}": F.count_if(F.col("b") == i) for i in range(len(LENGTHS) - 1)},
    }
    found = rows.groupBy("run", "k").agg(*(v.alias(n) for n, v in sums.items()))
    return time.dense(found, ["run"], "k", time.ranges_of(found, ["run"], "k"), dict.fromkeys(sums, 0))


#: All boundaries from the first arrival to the last terminal time: what never ends is seen up to there.
BOUNDS = f"bounds AS (SELECT (min(arrival_ns) + {WEEK - 1}) // {WEEK} AS lo, (greatest(max(arrival_ns), max(terminal_ns)) + {WEEK - 1}) // {WEEK} AS hi FROM life)"


def bounds(t: Tables) -> DataFrame:
    """(lo, hi): one row."""
    return t.life.agg(F.min("arrival_ns").alias("a"), F.greatest(F.max("arrival_ns"), F.max("terminal_ns")).alias("b")).select(boundary_at_or_after("a", WEEK).alias("lo"), boundary_at_or_after("b", WEEK).alias("hi"))


def last_boundary(t: Tables) -> int:
    return bounds(t).first().hi or 0


#: The ladder at one boundary, in SQL: independent of the interval form.
LADDER = """CASE
    WHEN terminal_event = 'request_rejected' THEN CASE WHEN terminal_ns IS NOT NULL AND t >= terminal_ns THEN NULL ELSE 'ADMITTED' END
    WHEN terminal_ns IS NOT NULL AND t >= terminal_ns THEN NULL
    WHEN NOT accepted THEN 'ADMITTED'
    WHEN submit_ns IS NULL OR t < submit_ns THEN 'ADMITTED'
    WHEN coalesce(prefill_scheduled_ns, prefill_added_ns) IS NULL OR t < coalesce(prefill_scheduled_ns, prefill_added_ns) THEN 'PREFILL_WAITING'
    WHEN coalesce(prefill_terminal_ns, prefill_complete_ns) IS NULL OR t < coalesce(prefill_terminal_ns, prefill_complete_ns) THEN 'PREFILL_RUNNING'
    WHEN kv_enqueue_ns IS NULL OR t < kv_enqueue_ns THEN 'HANDOFF_WAITING'
    WHEN kv_start_ns IS NULL OR t < kv_start_ns THEN 'KV_QUEUED'
    WHEN kv_ready_ns IS NULL OR t < kv_ready_ns THEN 'KV_TRANSFERRING'
    WHEN decode_added_ns IS NULL OR t < decode_added_ns THEN 'KV_READY'
    WHEN coalesce(decode_scheduled_ns, decode_added_ns) IS NULL OR t < coalesce(decode_scheduled_ns, decode_added_ns) THEN 'DECODE_WAITING'
    ELSE 'DECODE_RUNNING' END"""
AT = f"""{BOUNDS}, b AS (SELECT *, k * {WEEK} AS t FROM (SELECT *, unnest(generate_series((arrival_ns + {WEEK - 1}) // {WEEK}, (SELECT hi FROM bounds))) AS k FROM life) z),
s AS (SELECT * FROM (SELECT *, {LADDER} AS state FROM b WHERE t >= arrival_ns AND (terminal_ns IS NULL OR t < terminal_ns)) z WHERE state IS NOT NULL)"""


@query(f"{AT} SELECT k, state, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM s GROUP BY k, state")
def state_at_boundary(t: Tables) -> DataFrame:
    amounts = {"n": F.lit(1).cast("long"), "tokens": F.col("input_tokens")}
    return time.dense_inventory(states.intervals(t.life), ["state"], "start_ns", "end_ns", WEEK, amounts, last_boundary(t)).select("k", "state", "n", "tokens")


@query(f"""{AT}
SELECT k, count(DISTINCT trace_id) AS active_traces, count(*) AS active_attempts, count(*) FILTER (WHERE state = 'PREFILL_WAITING') AS prefill_waiting,
       CAST(coalesce(sum(input_tokens) FILTER (WHERE state IN ('PREFILL_WAITING', 'PREFILL_RUNNING')), 0) AS BIGINT) AS prefill_tokens,
       count(*) FILTER (WHERE state IN ('HANDOFF_WAITING', 'KV_QUEUED', 'KV_TRANSFERRING', 'KV_READY')) AS handoff_pending,
       count(*) FILTER (WHERE state IN ('KV_READY', 'DECODE_WAITING')) AS ready_wait,
       count(*) FILTER (WHERE state = 'DECODE_RUNNING' AND side = 0) AS running_0, count(*) FILTER (WHERE state = 'DECODE_RUNNING' AND side = 1) AS running_1,
       abs(count(*) FILTER (WHERE side = 0) - count(*) FILTER (WHERE side = 1)) AS imbalance
FROM s GROUP BY k""")
def state_scalars(t: Tables) -> DataFrame:
    """Inventories by state and side at each boundary, added up; the active traces are those of merged intervals."""
    last = last_boundary(t)
    spans = states.intervals(t.life)
    amounts = {"n": F.lit(1).cast("long"), "tokens": F.col("input_tokens")}
    at = time.dense_inventory(spans, ["state", "side"], "start_ns", "end_ns", WEEK, amounts, last)
    traces = time.dense_inventory(time.merged(spans, ["trace_id"], "start_ns", "end_ns"), [], "start_ns", "end_ns", WEEK, {"active_traces": F.lit(1).cast("long")}, last)
    of = lambda c, what="n": F.coalesce(F.sum(F.when(c, F.col(what))), F.lit(0))
    is_ = lambda *x: F.col("state").isin(*x)
    sums = at.groupBy("k").agg(
        F.sum("n").alias("active_attempts"), of(is_("PREFILL_WAITING")).alias("prefill_waiting"), of(is_("PREFILL_WAITING", "PREFILL_RUNNING"), "tokens").alias("prefill_tokens"),
        of(is_("HANDOFF_WAITING", "KV_QUEUED", "KV_TRANSFERRING", "KV_READY")).alias("handoff_pending"), of(is_("KV_READY", "DECODE_WAITING")).alias("ready_wait"),
        of(is_("DECODE_RUNNING") & (F.col("side") == 0)).alias("running_0"), of(is_("DECODE_RUNNING") & (F.col("side") == 1)).alias("running_1"), F.abs(of(F.col("side") == 0) - of(F.col("side") == 1)).alias("imbalance"),
    )
    return sums.join(traces, "k", "left").fillna(0, ["active_traces"])


AGES = [0, 7, 14, 28, 56, 112]
_AGE = "CASE " + " ".join(f"WHEN {{x}} >= {a} AND {{x}} < {b} THEN {i}" for i, (a, b) in enumerate(zip(AGES[:-1], AGES[1:], strict=True))) + f" ELSE {len(AGES) - 2} END"


@query(f"""{AT}, c AS (SELECT k, {_bins("input_tokens")} AS len_bin, {_AGE.format(x=f"(t - submit_ns) // {DAY_NS}")} AS age_bin, input_tokens FROM s WHERE state = 'PREFILL_WAITING'),
h AS (SELECT k, len_bin, age_bin, count(*) AS n, sum(input_tokens) AS mass FROM c GROUP BY ALL),
g AS (SELECT k, len_bin, age_bin FROM (SELECT DISTINCT k FROM s) a, (SELECT unnest(generate_series(0, {len(LENGTHS) - 2})) AS len_bin) b, (SELECT unnest(generate_series(0, {len(AGES) - 2})) AS age_bin) d)
SELECT g.k, CAST(g.len_bin AS INTEGER) AS len_bin, CAST(g.age_bin AS INTEGER) AS age_bin, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(mass, 0) AS BIGINT) AS mass
FROM g LEFT JOIN h ON g.k = h.k AND g.len_bin = h.len_bin AND g.age_bin = h.age_bin""")
def state_hist2d(t: Tables) -> DataFrame:
    """Waiting stays are cut where their age meets an edge; each piece is in one cell."""
    last = last_boundary(t)
    spans = states.intervals(t.life)
    stays = spans.where("state = 'PREFILL_WAITING'").withColumn("len_bin", bin_irregular("input_tokens", LENGTHS))
    pieces = time.by_age(stays, "submit_ns", "start_ns", "end_ns", [e * DAY_NS for e in AGES], "age_bin")
    cells = time.dense_inventory(pieces, ["len_bin", "age_bin"], "start_ns", "end_ns", WEEK, {"n": F.lit(1).cast("long"), "mass": F.col("input_tokens")}, last)
    some = time.dense_inventory(spans, [], "start_ns", "end_ns", WEEK, {"one": F.lit(1).cast("long")}, last).select("k")
    # the feature index is a fixed small table: every boundary has all its cells
    grid = some.select("k", F.explode(F.sequence(F.lit(0), F.lit(len(LENGTHS) - 2))).alias("len_bin")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(AGES) - 2))).alias("age_bin"))
    return grid.join(cells, ["k", "len_bin", "age_bin"], "left").fillna(0, ["n", "mass"])


@query(f"""
q AS (SELECT request_id, count(*) AS m, min(ts_ns) AS a, max(ts_ns) AS b FROM em GROUP BY request_id),
p AS (SELECT request_id, CASE WHEN m >= 2 THEN (b - a) / (m - 1) / 1e6 END AS tpot, a - 0 AS first_ns FROM q),
f AS (SELECT l.run, l.terminal_ns // {WEEK} AS k, l.terminal_event AS e, l.input_tokens, l.expected_tokens, p.tpot, (p.first_ns - l.arrival_ns) / 1e6 AS ttft
      FROM life l LEFT JOIN p ON l.request_id = p.request_id WHERE l.terminal_ns IS NOT NULL)
SELECT run, k, count(*) FILTER (WHERE e = 'request_complete') AS completed, CAST(coalesce(sum(expected_tokens) FILTER (WHERE e = 'request_complete'), 0) AS BIGINT) AS completed_tokens,
       count(*) FILTER (WHERE e = 'request_complete' AND ttft <= 5e9 AND (tpot IS NULL OR tpot <= 2e9)) AS good,
       count(*) FILTER (WHERE e = 'request_complete' AND NOT coalesce(ttft <= 5e9, FALSE)) AS ttft_violations, count(*) FILTER (WHERE e = 'request_complete' AND coalesce(tpot, 0) > 2e9) AS tpot_violations,
       round(coalesce(sum(coalesce(ttft, 0)) FILTER (WHERE e = 'request_complete'), 0) / 1e6, 3) AS ttft_sum, round(coalesce(sum(coalesce(tpot, 0)) FILTER (WHERE e = 'request_complete'), 0) / 1e6, 3) AS tpot_sum,
       count(*) FILTER (WHERE e = 'request_rejected') AS rejected, count(*) FILTER (WHERE e LIKE '%cancel%') AS cancelled, count(*) FILTER (WHERE e LIKE '%error%') AS failed
FROM f GROUP BY run, k""")
def window_output(t: Tables) -> DataFrame:
    gaps = t.em.groupBy("request_id").agg(ratio(F.max("ts_ns") - F.min("ts_ns"), F.count("*") - 1).alias("_g"), F.min("ts_ns").alias("first_ns"))
    rows = t.life.where("terminal_ns is not null").join(gaps, "request_id", "left").select("*", window_index("terminal_ns", WEEK).alias("k"), (F.col("_g") / 1e6).alias("tpot"), ((F.col("first_ns") - F.col("arrival_ns")) / 1e6).alias("ttft"))
    done, e = F.col("terminal_event") == "request_complete", F.col("terminal_event")
    in_time = F.coalesce(F.col("ttft") <= 5e9, F.lit(False))
    total = lambda x: F.coalesce(F.sum(F.when(done, x)), F.lit(0))
    return rows.groupBy("run", "k").agg(
        F.count_if(done).alias("completed"), total(F.col("expected_tokens")).alias("completed_tokens"), F.count_if(done & in_time & (F.col("tpot").isNull() | (F.col("tpot") <= 2e9))).alias("good"),
        F.count_if(done & ~in_time).alias("ttft_violations"), F.count_if(done & (F.coalesce("tpot", F.lit(0.0)) > 2e9)).alias("tpot_violations"),
        F.round(total(F.coalesce("ttft", F.lit(0.0))) / 1e6, 3).alias("ttft_sum"), F.round(total(F.coalesce("tpot", F.lit(0.0))) / 1e6, 3).alias("tpot_sum"),
        F.count_if(e == "request_rejected").alias("rejected"), F.count_if(e.contains("cancel")).alias("cancelled"), F.count_if(e.contains("error")).alias("failed"),
    )


@query("SELECT request_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN round((max(ts_ns) - min(ts_ns)) / (count(*) - 1) / 1e6, 3) END AS tpot_ms FROM em GROUP BY request_id")
def tpot(t: Tables) -> DataFrame:
    return t.em.groupBy("request_id").agg(F.count("*").alias("n"), F.round(ratio(F.max("ts_ns") - F.min("ts_ns"), F.count("*") - 1) / 1e6, 3).alias("tpot_ms"))


@query(f"SELECT ts_ns // {HOUR} AS k, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL")
def window_assign(t: Tables) -> DataFrame:
    return t.ev.groupBy(window_index("ts_ns", HOUR).alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev WHERE ts_ns >= 1704585600000000000 AND ts_ns < 1705190400000000000 GROUP BY event_type")
def window_range_filter(t: Tables) -> DataFrame:
    # the bounds are on the column as it is stored, so that the scan gets them
    rows = t.events.where("ts >= timestamp_ntz'2024-01-07 00:00:00' and ts < timestamp_ntz'2024-01-14 00:00:00'")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL")
def filter_pushdown(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1997-01-01'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"""
i AS (SELECT side, submit_ns AS a, kv_enqueue_ns AS b FROM life WHERE submit_ns IS NOT NULL AND kv_enqueue_ns IS NOT NULL),
x AS (SELECT side, unnest(generate_series((a + {WEEK - 1}) // {WEEK}, (b + {WEEK - 1}) // {WEEK} - 1)) AS k FROM i WHERE (a + {WEEK - 1}) // {WEEK} <= (b + {WEEK - 1}) // {WEEK} - 1)
SELECT side, k, count(*) AS n FROM x GROUP BY side, k""")
def interval_boundaries(t: Tables) -> DataFrame:
    rows = t.life.where("submit_ns is not null and kv_enqueue_ns is not null")
    return time.on_boundaries(rows, "submit_ns", "kv_enqueue_ns", WEEK, 0, 1 << 40).groupBy("side", "k").agg(F.count("*").alias("n"))


@query(f"""
i AS (SELECT side, (arrival_ns + {WEEK - 1}) // {WEEK} AS a, (terminal_ns + {WEEK - 1}) // {WEEK} AS b, input_tokens AS m FROM life WHERE terminal_ns IS NOT NULL),
d AS (SELECT side, a AS k, 1 AS n, m FROM i WHERE a < b UNION ALL SELECT side, b, -1, -m FROM i WHERE a < b),
c AS (SELECT side, k, sum(n) AS n, sum(m) AS m FROM d GROUP BY side, k)
SELECT side, k, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(m) OVER w AS BIGINT) AS tokens FROM c WINDOW w AS (PARTITION BY side ORDER BY k)""")
def inventory_cumsum(t: Tables) -> DataFrame:
    rows = t.life.where("terminal_ns is not null")
    return time.inventory(rows, ["side"], "arrival_ns", "terminal_ns", WEEK, {"n": F.lit(1).cast("long"), "tokens": F.col("input_tokens")})


@query("""
x AS (SELECT request_id, seq, n, ts_ns, CAST(coalesce(sum(n) OVER (PARTITION BY request_id ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM em)
SELECT x.request_id, x.seq, before, greatest(a.expected_tokens - before, 0) AS remaining FROM x JOIN att a ON a.request_id = x.request_id""")
def running_emissions(t: Tables) -> DataFrame:
    rows = t.em.withColumn("before", time.running_before(t.em, ["request_id"], "ts_ns", "n"))
    return rows.join(t.att.select("request_id", "expected_tokens"), "request_id").select("request_id", "seq", "before", F.greatest(F.col("expected_tokens") - F.col("before"), F.lit(0)).alias("remaining"))


#: Commands: sign-ups, whose value is held from then on; the windows are those of one day.
_CMD = """cmd AS (SELECT run_id, ts_ns, round(value, 2) AS u, event_id FROM ev WHERE event_type = 'signup'),
win AS (SELECT run_id, unnest(generate_series(min(ts_ns // 3600000000000), max(ts_ns // 3600000000000))) AS k FROM ev GROUP BY run_id)"""


def _windows(t: Tables) -> DataFrame:
    return time.ranges_of(t.ev.withColumn("k", window_index("ts_ns", HOUR)), ["run_id"], "k").select("run_id", F.explode(F.sequence("lo", "hi")).alias("k")).withColumn("start_ns", F.col("k") * HOUR)


def _commands(t: Tables) -> DataFrame:
    return t.ev.where("event_type = 'signup'").select("run_id", F.col("ts_ns").alias("applied_ns"), F.round("value", 2).alias("u"), "event_id")


@query(f"""{_CMD},
x AS (SELECT w.run_id, w.k, c.u, c.ts_ns AS applied_ns, row_number() OVER (PARTITION BY w.run_id, w.k ORDER BY c.ts_ns DESC, c.event_id DESC) AS r
      FROM win w LEFT JOIN cmd c ON c.run_id = w.run_id AND c.ts_ns <= w.k * {HOUR})
SELECT run_id, k, u, applied_ns FROM x WHERE r = 1""")
def asof_control(t: Tables) -> DataFrame:
    return time.as_of(_windows(t), _commands(t), ["run_id"], "start_ns", "applied_ns", ["u", "applied_ns"], ["event_id"]).select("run_id", "k", "u", "applied_ns")


@query(f"""{_CMD},
h AS (SELECT w.run_id, w.k, (SELECT max(struct_pack(a := c.ts_ns, b := c.event_id, u := c.u)) FROM cmd c WHERE c.run_id = w.run_id AND c.ts_ns <= w.k * {HOUR}) AS c FROM win w),
u AS (SELECT run_id, k, c.u AS u, c.a AS applied_ns FROM h WHERE c IS NOT NULL),
v AS (SELECT run_id, ts_ns // {HOUR} AS k, count(*) AS routed, count(*) FILTER (WHERE k % 2 = 0) AS routed_a, sum(k) AS mass, coalesce(sum(k) FILTER (WHERE k % 2 = 0), 0) AS mass_a FROM ev WHERE event_type <> 'signup' GROUP BY 1, 2)
SELECT u.run_id, u.k, u.u, coalesce(lag(u.u) OVER w, u.u) AS u_prev, round(coalesce(u.u - lag(u.u) OVER w, 0), 6) AS delta_u, round((u.k * {HOUR} - applied_ns) / 1e9, 6) AS since_change,
       CAST(coalesce(routed, 0) AS BIGINT) AS routed, CAST(coalesce(routed_a, 0) AS BIGINT) AS routed_a, round(routed_a / routed, 9) AS request_ratio, round(CASE WHEN mass > 0 THEN mass_a / mass END, 9) AS token_ratio
FROM u LEFT JOIN v ON u.run_id = v.run_id AND u.k = v.k WINDOW w AS (PARTITION BY u.run_id ORDER BY u.k)""")
def control_windows(t: Tables) -> DataFrame:
    held = time.as_of(_windows(t), _commands(t), ["run_id"], "start_ns", "applied_ns", ["u", "applied_ns"], ["event_id"]).where("u is not null")
    a = F.col("k") % 2 == 0
    routes = t.ev.where("event_type <> 'signup'").groupBy("run_id", window_index("ts_ns", HOUR).alias("w")).agg(F.count("*").alias("routed"), F.count_if(a).alias("routed_a"), F.sum("k").alias("mass"), F.sum(F.when(a, F.col("k")).otherwise(0)).alias("mass_a")).withColumnRenamed("w", "k")
    w = W.partitionBy("run_id").orderBy("k")
    out = held.join(routes, ["run_id", "k"], "left").withColumn("u_prev", F.coalesce(F.lag("u").over(w), F.col("u")))
    return out.select("run_id", "k", "u", "u_prev", F.round(F.col("u") - F.col("u_prev"), 6).alias("delta_u"), F.round((F.col("start_ns") - F.col("applied_ns")) / 1e9, 6).alias("since_change"),
                      F.coalesce("routed", F.lit(0)).alias("routed"), F.coalesce("routed_a", F.lit(0)).alias("routed_a"), F.round(ratio("routed_a", "routed"), 9).alias("request_ratio"), F.round(ratio("mass_a", "mass"), 9).alias("token_ratio"))


@query(f"""
s AS (SELECT ts_ns FROM ev WHERE event_type = 'error'), w AS (SELECT DISTINCT ts_ns // {HOUR} AS k FROM ev)
SELECT k, (SELECT min(abs(s.ts_ns - (k * {HOUR} + {HOUR // 2}))) FROM s) AS gap FROM w""")
def nearest_sample(t: Tables) -> DataFrame:
    """Only the first and the last sample of each half hour can be nearest to a centre: what is sorted is a row for each stretch between two centres."""
    half = HOUR // 2
    sample = F.when(F.col("event_type") == "error", F.col("ts_ns"))
    halves = t.ev.groupBy(window_index("ts_ns", half).alias("h")).agg(F.min(sample).alias("lo"), F.max(sample).alias("hi"))
    # a half hour belongs to the hour whose centre asks, and to the stretch from the last centre before it to the next
    none = F.lit(None).cast("long")
    parts = F.array(F.struct(window_index("h", 2).alias("k"), F.lit(True).alias("asked"), none.alias("lo"), none.alias("hi")), F.struct(window_index(F.col("h") - 1, 2).alias("k"), F.lit(False).alias("asked"), F.col("lo"), F.col("hi")))
    stretches = halves.select(F.inline(parts)).groupBy("k").agg(F.max("asked").alias("asked"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = F.max("hi").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    after = F.min("lo").over(W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0))  # from the last on: a frame that only grows
    centre = F.col("k") * HOUR + half
    found = stretches.select("k", "asked", before.alias("_b"), after.alias("_a")).where("asked")
    return found.select("k", F.least(centre - F.col("_b"), F.col("_a") - centre).alias("gap"))


@query(f"""
x AS (SELECT run_id, (SELECT max(e.ts_ns) FROM ev e WHERE e.run_id = r.run_id AND e.ts_ns <= 1705276800000000000) AS before_ns, (SELECT min(e.ts_ns) FROM ev e WHERE e.run_id = r.run_id AND e.ts_ns >= 1705276800000000000) AS after_ns FROM (SELECT DISTINCT run_id FROM ev) r)
SELECT x.run_id, before_ns, after_ns, (SELECT min(event_id) FROM ev e WHERE e.run_id = x.run_id AND e.ts_ns = before_ns) AS before_id, (SELECT min(event_id) FROM ev e WHERE e.run_id = x.run_id AND e.ts_ns = after_ns) AS after_id FROM x""")
def nearest_before_after(t: Tables) -> DataFrame:
    at = F.lit(1_705_276_800_000_000_000)
    before, after = F.when(F.col("ts_ns") <= at, F.struct("ts_ns", (-F.col("event_id")).alias("i"))), F.when(F.col("ts_ns") >= at, F.struct("ts_ns", F.col("event_id").alias("i")))
    g = t.ev.groupBy("run_id").agg(F.max(before).alias("b"), F.min(after).alias("a"))
    return g.select("run_id", F.col("b.ts_ns").alias("before_ns"), F.col("a.ts_ns").alias("after_ns"), (-F.col("b.i")).alias("before_id"), F.col("a.i").alias("after_id"))


@query(f"""
x AS (SELECT l.request_id, (l.submit_ns + {WEEK - 1}) // {WEEK} AS k, e.component, e.n, e.ts_ns, row_number() OVER (PARTITION BY l.request_id, e.component ORDER BY e.ts_ns DESC, e.seq DESC, e.n DESC) AS r
      FROM life l JOIN em e ON e.request_id = l.request_id AND e.ts_ns < ((l.submit_ns + {WEEK - 1}) // {WEEK} + 4) * {WEEK})
SELECT request_id, component, ts_ns, n FROM x WHERE r = 1""")
def asof_membership(t: Tables) -> DataFrame:
    at = t.life.where("submit_ns is not null").select("request_id", ((-window_index(-F.col("submit_ns"), WEEK) + 4) * WEEK).alias("at_ns"))
    rows = t.em.join(at, "request_id").where("ts_ns < at_ns")
    return rows.groupBy("request_id", "component").agg(F.max(F.struct("ts_ns", "seq", "n")).alias("x")).select("request_id", "component", "x.ts_ns", "x.n")


@query(f"SELECT request_id, seq, {_bins('n * 40')} AS b, least(greatest(n, 0) // 8, 5) AS e FROM em", name="bin_irregular")
def bin_irregular_edges(t: Tables) -> DataFrame:
    return t.em.select("request_id", "seq", bin_irregular(F.col("n") * 40, LENGTHS).alias("b"), bin_equal("n", 40, 8).cast("long").alias("e"))


@query(f"SELECT {_bins('input_tokens')} AS b, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM att GROUP BY 1")
def bin_irregular_counts(t: Tables) -> DataFrame:
    return t.att.groupBy(bin_irregular("input_tokens", LENGTHS).alias("b")).agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))


@query("SELECT CAST(least(greatest(input_tokens, 0) // 256, 8) AS INTEGER) AS b, count(*) AS n FROM att GROUP BY 1")
def hist_equal_width(t: Tables) -> DataFrame:
    return t.att.groupBy(bin_equal("input_tokens", 2048, 256).alias("b")).agg(F.count("*").alias("n"))


@query("SELECT request_id, CASE WHEN client % 3 = 0 THEN 0 WHEN client % 3 = 1 THEN 1 END AS side FROM att")
def case_route_side(t: Tables) -> DataFrame:
    endpoint = F.concat(F.lit("0.0.0.0:"), F.element_at(F.array(F.lit("13701"), F.lit("13702"), F.lit("8080")), (F.col("client") % 3 + 1).cast("int")))
    return t.att.select("request_id", side_of(endpoint).alias("side"))


@query(f"""SELECT event_id, round((ts_ns % {DAY_NS}) / {float(DAY_NS)}, 9) AS phase, round(sin((ts_ns % {DAY_NS}) / {float(DAY_NS)} * 2 * pi()), 6) AS phase_sin,
           round(cos((ts_ns % {DAY_NS}) / {float(DAY_NS)} * 2 * pi()), 6) AS phase_cos, round(ln(1 + value), 6) AS log_load FROM ev""", name="phase_features")
def phase_feature_map(t: Tables) -> DataFrame:
    return t.ev.select("event_id", *phase_features("ts_ns", DAY_NS, "value")).select("event_id", F.round("phase", 9).alias("phase"), *(F.round(c, 6).alias(c) for c in ("phase_sin", "phase_cos", "log_load")))


@query(f"SELECT arrival_ns // {WEEK} AS k, CAST(2 * count(*) FILTER (WHERE side = 0) - count(*) AS BIGINT) AS requests, CAST(2 * coalesce(sum(expected_tokens) FILTER (WHERE side = 0), 0) - sum(expected_tokens) AS BIGINT) AS tokens FROM att GROUP BY 1")
def signed_forcing(t: Tables) -> DataFrame:
    g = t.att.groupBy(window_index("arrival_ns", WEEK).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("a"), F.sum("expected_tokens").alias("m"), F.sum(F.when(F.col("side") == 0, F.col("expected_tokens")).otherwise(0)).alias("ma"))
    return g.select("k", signed("n", "a").alias("requests"), signed("m", "ma").alias("tokens"))


@query(f"""
f AS (SELECT arrival_ns // {WEEK} AS k, 'decode-' || side || '.tokens' AS name, sum(expected_tokens) AS v FROM att GROUP BY ALL)
SELECT a.k, a.name, round((a.v + b.v) / 2, 6) AS common, round((a.v - b.v) / 2, 6) AS difference FROM f a JOIN f b ON a.k = b.k AND b.name = replace(a.name, 'decode-0', 'decode-1') WHERE a.name LIKE 'decode-0%'""")
def common_diff_pairs(t: Tables) -> DataFrame:
    f = t.att.groupBy(window_index("arrival_ns", WEEK).alias("k"), F.concat(F.lit("decode-"), "side", F.lit(".tokens")).alias("name")).agg(F.sum("expected_tokens").alias("v"))
    left = f.where("name like 'decode-0%'").select("k", "name", "v", F.replace("name", F.lit("decode-0"), F.lit("decode-1")).alias("other"))
    pairs = left.join(f.select("k", F.col("name").alias("other"), F.col("v").alias("w")), ["k", "other"])
    return pairs.select("k", "name", F.round((F.col("v") + F.col("w")) / 2, 6).alias("common"), F.round((F.col("v") - F.col("w")) / 2, 6).alias("difference"))


_WEEKLY = f"wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS tokens, CAST(max(expected_tokens) AS BIGINT) AS peak FROM att GROUP BY ALL)"


def weekly(t: Tables) -> DataFrame:
    return t.att.groupBy("run", window_index("arrival_ns", WEEK).alias("k")).agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"), F.max("expected_tokens").alias("peak"))


@query(f"""{_WEEKLY}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i FROM wk)
SELECT run, i // 4 AS block, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, arg_min(peak, i) AS peak FROM r GROUP BY 1, 2 HAVING count(*) = 4""")
def block_sum(t: Tables) -> DataFrame:
    return time.block_sum(weekly(t), ["run"], "k", 4, ["n", "tokens"], ["peak"])


@query(f"""{_WEEKLY}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i FROM wk)
SELECT run, i // 5 AS slow, CAST(sum(n) AS BIGINT) AS completed, round(sum(tokens) / 5.0, 6) AS throughput, round(CAST(sum(peak) AS DOUBLE) * CAST(0.2 AS DOUBLE), 6) AS peak_integral, round(sum(tokens) / nullif(sum(n), 0), 6) AS mean_tokens,
       arg_min(n, i) AS n_start, arg_max(n, i) AS n_end, arg_max(n, i) - arg_min(n, i) AS n_delta FROM r GROUP BY 1, 2 HAVING count(*) = 5""")
def slow_kpi(t: Tables) -> DataFrame:
    i = F.row_number().over(W.partitionBy("run").orderBy("k")) - 1
    r = weekly(t).withColumn("i", i).withColumn("slow", window_index("i", 5))
    g = r.groupBy("run", "slow").agg(F.sum("n").alias("completed"), F.sum("tokens").alias("m"), F.sum("peak").alias("p"), F.min_by("n", "i").alias("n_start"), F.max_by("n", "i").alias("n_end"), F.count("*").alias("c")).where("c = 5")
    return g.select("run", "slow", "completed", F.round(F.col("m") / 5.0, 6).alias("throughput"), F.round(F.col("p") * 0.2, 6).alias("peak_integral"), F.round(ratio("m", "completed"), 6).alias("mean_tokens"), "n_start", "n_end", (F.col("n_end") - F.col("n_start")).alias("n_delta"))


@query(f"""{_WEEKLY}
SELECT run, k, n, n - coalesce(lag(n) OVER w, n) AS velocity, coalesce(lag(tokens) OVER w, 0) AS tokens_before FROM wk WINDOW w AS (PARTITION BY run ORDER BY k)""")
def markov_lag(t: Tables) -> DataFrame:
    w = W.partitionBy("run").orderBy("k")
    return weekly(t).select("run", "k", "n", (F.col("n") - F.coalesce(F.lag("n").over(w), F.col("n"))).alias("velocity"), F.coalesce(F.lag("tokens").over(w), F.lit(0)).alias("tokens_before"))


@query(f"""{_WEEKLY}
SELECT run, k, n, {", ".join(f"coalesce(lag(n, {i}) OVER w, first_value(n) OVER w) AS n_lag{i}" for i in range(1, 5))} FROM wk WINDOW w AS (PARTITION BY run ORDER BY k)""")
def raw_lag(t: Tables) -> DataFrame:
    return time.lagged(weekly(t).select("run", "k", "n"), ["run"], "k", "n", 4)


@query(f"""{_WEEKLY}
SELECT run, k, round(avg(n) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean_4, round(CAST(sum(n) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DOUBLE) * CAST(0.2 AS DOUBLE), 6) AS integral_4,
       n - coalesce(lag(n, 4) OVER w, first_value(n) OVER w) AS change_4 FROM wk WINDOW w AS (PARTITION BY run ORDER BY k)""")
def moving_stats(t: Tables) -> DataFrame:
    return time.moving(weekly(t), ["run"], "k", "n", 4, 0.2).select("run", "k", F.round("mean_4", 6).alias("mean_4"), F.round("integral_4", 6).alias("integral_4"), "change_4")


@query(f"""{_WEEKLY}, r AS (SELECT run, k, n, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i FROM wk)
SELECT b.run, b.k, round(pow(exp(-0.25), b.i) * first(f.n) + coalesce(sum((1 - exp(-0.25)) * pow(exp(-0.25), b.i - 1 - a.i) * a.n), 0), 5) AS memory
FROM r b JOIN r f ON f.run = b.run AND f.i = 0 LEFT JOIN r a ON a.run = b.run AND a.i < b.i GROUP BY b.run, b.k, b.i""")
def ewma(t: Tables) -> DataFrame:
    return time.ewma(weekly(t), ["run"], "k", "n", 4).select("run", "k", F.round("memory", 5).alias("memory"))


@query(f"""{_WEEKLY}, r AS (SELECT run, n, tokens, row_number() OVER (PARTITION BY run ORDER BY k) AS i FROM wk)
SELECT a.run, l.lag, count(*) AS n, round(corr(a.n, b.tokens), 6) AS corr FROM r a, (SELECT unnest(generate_series(0, 6)) AS lag) l, r b WHERE b.run = a.run AND b.i = a.i + l.lag GROUP BY a.run, l.lag""")
def lag_corr(t: Tables) -> DataFrame:
    return time.cross_correlation(weekly(t), ["run"], "k", "n", "tokens", 6).select("run", "lag", "n", F.round("corr", 6).alias("corr"))


@query(f"SELECT request_id, seq, ts_ns // {WEEK} + 1 AS shows_at, (ts_ns + {WEEK - 1}) // {WEEK} AS opens_at FROM em")
def boundary_ownership(t: Tables) -> DataFrame:
    return t.em.select("request_id", "seq", boundary_after("ts_ns", WEEK).alias("shows_at"), (-window_index(-F.col("ts_ns"), WEEK)).alias("opens_at"))
