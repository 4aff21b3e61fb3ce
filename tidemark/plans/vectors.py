"""Queries of whole vectors: all state blocks, all window outputs, forcing and outflow series, closures and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import DAY_NS, bin_irregular, boundary_after, phase_features, ratio, window_index
from tidemark.operators import engine, states, survival, time, vectors
from tidemark.plans.events import _STAGES, staged, stage_inventory, transfer_events
from tidemark.plans.models import _EDGES, _STAY
from tidemark.plans.registry import Tables, query
from tidemark.plans.windows import _WEEKLY, AT, LENGTHS, WEEK, _bins, last_boundary, weekly

DAYS = [0, 2, 5, 9, 14, 28]
#: Slack against a limit of 20 days, from the least to the most.
LIMIT, SLACKS = 20, [-10, -4, 0, 4, 10]
PROGRESS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _case(x: str, edges: list[float], last: int) -> str:
    """The bin of x by edges, the first without a lower bound; last: number of the bin beyond them."""
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {last} END"


_DEC = "CASE client % 3 WHEN 0 THEN 'decode-0' WHEN 1 THEN 'decode-1' END"
_PHASES = {"HANDOFF_WAITING": ("handoff_wait", "prefill_terminal_ns"), "KV_QUEUED": ("kv_queue", "kv_enqueue_ns"), "KV_TRANSFERRING": ("kv_inflight", "kv_start_ns"), "DECODE_WAITING": ("kv_ready_wait", "kv_ready_ns")}
_AGE_BIN = _case("{x}", [d * DAY_NS for d in DAYS[1:]], len(DAYS) - 1)


#: Emissions, and what memberships of an engine say was there before: computed tokens of a prefill, context of a decode.
_MARKS = "mk AS (SELECT request_id, ts_ns, seq, n, component, 40 * coalesce(sum(n) OVER (PARTITION BY request_id, component ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM em)"
#: The context of a decode, from nothing known (its request's input) up, and the slack between tokens against a limit of 6 days.
CONTEXTS, PAUSE, PAUSES = [0, 500, 1000, 2000, 4000], 6, [-30, -10, 0, 3]


def marks(t: Tables) -> DataFrame:
    """(request_id, ts_ns, seq, generated, emitted_ns, and by component the tokens: as a sum, and as those of the last mark) of each emission and membership.

    Those of a component that agree in time and number are one: nothing tells which came first, so none is before the others.
    """
    # requests are dealt once: all that follows up to the join with their spans is by request
    em = t.em.repartition("request_id").groupBy("request_id", "component", "ts_ns", "seq").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    decoded = F.col("component") != "prefill"
    by = [F.when(F.col("component") == kind, F.col("n")).alias(f"{name}_{part}") for part in ("all", "last") for kind, name in _KINDS.items()]
    return em.select("request_id", "ts_ns", "seq", F.when(decoded, F.col("n")).alias("generated"), F.when(decoded, F.col("ts_ns")).alias("emitted_ns"), *by)


#: Components and the names of what is known by them.
_KINDS = {"prefill": "prefill", "decode-0": "decode_0", "decode-1": "decode_1"}


@query(f"""{AT}, {_MARKS}, z AS (SELECT *, {_DEC} AS worker, {_bins("input_tokens")} AS x FROM s),
j AS (SELECT z.request_id, z.k, CAST(coalesce(sum(e.n) FILTER (WHERE component <> 'prefill'), 0) AS BIGINT) AS generated, max(e.ts_ns) FILTER (WHERE component <> 'prefill') AS emitted_ns,
             arg_max(before, ROW(e.ts_ns, e.seq)) FILTER (WHERE component = 'prefill') AS computed, arg_max(before, ROW(e.ts_ns, e.seq)) FILTER (WHERE component = worker) AS context
      FROM z LEFT JOIN mk e ON e.request_id = z.request_id AND e.ts_ns < z.t WHERE z.state IN ('PREFILL_RUNNING', 'DECODE_WAITING', 'DECODE_RUNNING') GROUP BY z.request_id, z.k),
g AS (SELECT z.*, generated, emitted_ns, coalesce(computed, 0) AS computed, coalesce(nullif(context, 0), input_tokens) AS context, {_case("coalesce(nullif(context, 0), input_tokens)", [str(c) for c in CONTEXTS[1:]], len(CONTEXTS) - 1)} AS c FROM z JOIN j ON j.request_id = z.request_id AND j.k = z.k),
a AS (SELECT k, 'prefill_wait' AS block, '' AS worker, x, {_AGE_BIN.format(x="t - submit_ns")} AS y, 1 AS n, input_tokens AS mass FROM z WHERE state = 'PREFILL_WAITING'
      UNION ALL SELECT k, 'prefill_slack', '', x, {_case(f"{LIMIT * DAY_NS} - (t - arrival_ns)", [f"{s * DAY_NS}" for s in SLACKS], len(SLACKS))}, 1, input_tokens FROM z WHERE state IN ('PREFILL_WAITING', 'PREFILL_RUNNING')
      {" ".join(f"UNION ALL SELECT k, '{b}', worker, 0, {_AGE_BIN.format(x=f'coalesce(t - {anchor}, 0)')}, 1, expected_tokens FROM z WHERE state = '{state}' AND worker IS NOT NULL" for state, (b, anchor) in _PHASES.items())}
      UNION ALL SELECT k, 'prefill_running', '', x, {_case("computed / greatest(input_tokens, 1)", [str(p) for p in PROGRESS[1:]], len(PROGRESS) - 1)}, 1, greatest(input_tokens - computed, 0) FROM g WHERE state = 'PREFILL_RUNNING'
      UNION ALL SELECT k, 'first_token_pending', worker, c, 0, 1, context FROM g WHERE state = 'DECODE_WAITING' AND worker IS NOT NULL AND emitted_ns IS NULL
      UNION ALL SELECT k, 'decode_wait', worker, c, {_case(f"{PAUSE * DAY_NS} - (t - emitted_ns)", [f"{s * DAY_NS}" for s in PAUSES], len(PAUSES))}, 1, context FROM g WHERE state = 'DECODE_WAITING' AND worker IS NOT NULL AND emitted_ns IS NOT NULL
      UNION ALL SELECT k, b, worker, c, {_case("generated / greatest(expected_tokens, 1)", [str(p) for p in PROGRESS[1:]], len(PROGRESS) - 1)}, 1, CASE b WHEN 'decode_running' THEN greatest(greatest(expected_tokens, 1) - generated, 0) ELSE context END
      FROM g, (SELECT unnest(['decode_running', 'decode_context']) AS b) WHERE state = 'DECODE_RUNNING' AND worker IS NOT NULL)
SELECT k, block, worker, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n, CAST(sum(mass) AS BIGINT) AS mass FROM a WHERE y IS NOT NULL GROUP BY k, block, worker, x, y""")
def state_blocks(t: Tables) -> DataFrame:
    """Every two-dimensional block of the state, a row for each cell that isn't empty: intervals cut where a cell ends, then deltas."""
    spans = time.seen(states.intervals(t.life), "start_ns", "end_ns", WEEK).withColumn("worker", F.expr(_DEC)).withColumn("x", bin_irregular("input_tokens", LENGTHS))
    days, slacks, pauses = ([d * DAY_NS for d in x] for x in (DAYS, SLACKS, PAUSES))
    is_ = lambda *x: F.col("state").isin(*x)
    none, x, prompt, routed = F.lit(""), F.col("x"), F.col("input_tokens"), F.col("worker").isNotNull()
    of = [(is_("PREFILL_WAITING"), vectors.aged("prefill_wait", "submit_ns", days, none, x, prompt)), (is_("PREFILL_WAITING", "PREFILL_RUNNING"), vectors.slack("prefill_slack", "arrival_ns", LIMIT * DAY_NS, slacks, none, x, prompt))]
    of += [(is_(state) & routed, vectors.aged(block, anchor, days, F.col("worker"), F.lit(0), F.col("expected_tokens"))) for state, (block, anchor) in _PHASES.items()]

    known = spans.where(is_("PREFILL_RUNNING") | (is_("DECODE_WAITING", "DECODE_RUNNING") & routed))
    known = time.seen(vectors.tracked(known, marks(t), "request_id", ["generated", *(f"{n}_all" for n in _KINDS.values())], ["emitted_ns", *(f"{n}_last" for n in _KINDS.values())], "seq"), "start_ns", "end_ns", WEEK)
    # what was before a component's last mark: all its tokens so far without that mark's
    before = lambda n: (F.col(f"{n}_all") - F.col(f"{n}_last")) * 40
    met = F.when(F.col("worker") == "decode-0", before("decode_0")).otherwise(before("decode_1"))
    known = known.withColumn("computed", F.coalesce(before("prefill"), F.lit(0))).withColumn("context", F.coalesce(F.nullif(met, F.lit(0)), prompt)).withColumn("c", bin_irregular("context", [*CONTEXTS, None]))
    context, c, worker, expected, begun = F.col("context"), F.col("c"), F.col("worker"), F.greatest("expected_tokens", F.lit(1)), F.col("emitted_ns").isNotNull()
    # as columns: written out in each cell, they would make a method too long for the compiler of the JVM
    known = known.withColumn("_part", F.col("computed") / F.greatest(prompt, F.lit(1))).withColumn("_share", F.col("generated") / expected)
    known = known.withColumn("_prefilled", vectors.share_bin(F.col("_part"), PROGRESS)).withColumn("_decoded", vectors.share_bin(F.col("_share"), PROGRESS))
    prefilled, decoded = F.col("_prefilled"), F.col("_decoded")
    running = vectors.whole("decode_running", worker, c, decoded, F.greatest(expected - F.col("generated"), F.lit(0))) + vectors.whole("decode_context", worker, c, decoded, context)
    further = [
        (is_("PREFILL_RUNNING"), vectors.whole("prefill_running", none, x, prefilled, F.greatest(prompt - F.col("computed"), F.lit(0)))), (is_("DECODE_WAITING") & ~begun, vectors.whole("first_token_pending", worker, c, F.lit(0), context)),
        (is_("DECODE_WAITING") & begun, vectors.slack("decode_wait", "emitted_ns", PAUSE * DAY_NS, pauses, worker, c, context)), (is_("DECODE_RUNNING"), running),
    ]
    pieces = vectors.cells(spans, of).unionByName(vectors.cells(known, further))
    amounts = {"n": F.lit(1).cast("long"), "mass": F.col("mass")}
    return time.dense_inventory(pieces, ["block", "worker", "x", "y"], "start_ns", "end_ns", WEEK, amounts, last_boundary(t)).where("n > 0").select("k", "block", "worker", "x", "y", "n", "mass")


@query(f"""w AS (SELECT run, arrival_ns // {WEEK} AS k, {_bins("input_tokens")} AS i, {_bins("expected_tokens")} AS o FROM life), h AS (SELECT run, k, 'input' AS side, i AS b FROM w UNION ALL SELECT run, k, 'output', o FROM w)
SELECT run, k, side, CAST(b AS INTEGER) AS b, count(*) AS n FROM h GROUP BY ALL""")
def arrival_histograms(t: Tables) -> DataFrame:
    """Arrivals of each window by input and by output length; empty bins have no row."""
    both = F.array(*(F.struct(F.lit(s).alias("side"), bin_irregular(c, LENGTHS).alias("b")) for s, c in (("input", "input_tokens"), ("output", "expected_tokens"))))
    rows = t.life.select("run", window_index("arrival_ns", WEEK).alias("k"), F.explode(both).alias("h"))
    return rows.groupBy("run", "k", F.col("h.side").alias("side"), F.col("h.b").alias("b")).agg(F.count("*").alias("n"))


_DONE = "e = 'request_complete'"


_OUTPUTS = f"""q AS (SELECT request_id, count(*) AS m, min(ts_ns) AS a, max(ts_ns) AS b, sum(n) AS out FROM em GROUP BY request_id),
f AS (SELECT l.terminal_ns // {WEEK} AS k, l.terminal_event AS e, l.input_tokens, q.out, CASE WHEN m >= 2 THEN (b - a) / (m - 1) / 1e6 END AS tpot, (a - l.arrival_ns) / 1e6 AS ttft FROM life l LEFT JOIN q ON q.request_id = l.request_id WHERE l.terminal_ns IS NOT NULL),
t AS (SELECT k, count(*) FILTER (WHERE {_DONE}) AS completed, sum(out) FILTER (WHERE {_DONE}) AS completed_output, sum(input_tokens) FILTER (WHERE {_DONE}) AS completed_prompt,
      count(*) FILTER (WHERE {_DONE} AND ttft <= 5e9 AND (tpot IS NULL OR tpot <= 2e9)) AS good, sum(out) FILTER (WHERE {_DONE} AND ttft <= 5e9 AND (tpot IS NULL OR tpot <= 2e9)) AS good_output,
      count(*) FILTER (WHERE {_DONE} AND NOT coalesce(ttft <= 5e9, FALSE)) AS ttft_violations, count(*) FILTER (WHERE {_DONE} AND coalesce(tpot, 0) > 2e9) AS tpot_violations,
      round(coalesce(sum(coalesce(ttft, 0)) FILTER (WHERE {_DONE}), 0) / 1e6, 3) AS ttft_sum, round(coalesce(sum(coalesce(tpot, 0)) FILTER (WHERE {_DONE}), 0) / 1e6, 3) AS tpot_sum,
      count(*) FILTER (WHERE e = 'request_rejected') AS rejected, count(*) FILTER (WHERE e LIKE '%cancel%') AS cancelled, count(*) FILTER (WHERE e LIKE '%error%') AS failed FROM f GROUP BY k),
o AS (SELECT ts_ns // {WEEK} AS k, sum(n) FILTER (WHERE component = 'decode-0') AS emitted_0, sum(n) FILTER (WHERE component = 'decode-1') AS emitted_1, sum(n) FILTER (WHERE component = 'prefill') AS prefill_scheduled, sum(n) FILTER (WHERE component <> 'prefill') AS decode_scheduled FROM em GROUP BY 1),
kr AS (SELECT request_id, rank % 2 AS r, max(ts_ns) FILTER (WHERE seq % 4 = 3) AS c, coalesce(sum(n * 4096) FILTER (WHERE seq % 4 = 3 AND n % 5 <> 0), 0) AS bytes, count(*) FILTER (WHERE seq % 4 = 3) > 0 AND count(*) FILTER (WHERE seq % 4 = 0) = 0 AND count(*) FILTER (WHERE seq % 4 = 2) = count(*) FILTER (WHERE seq % 4 = 3) AS ok FROM em GROUP BY 1, 2),
x AS (SELECT max(c) AS ready, sum(bytes) AS bytes, count(*) FILTER (WHERE ok) = 2 AND bool_and(ok) AS ok FROM kr GROUP BY request_id), v AS (SELECT ready // {WEEK} AS k, count(*) AS kv_completed, sum(bytes) AS kv_bytes, count(*) FILTER (WHERE NOT ok) AS kv_failed FROM x WHERE ready IS NOT NULL GROUP BY 1),
ks AS (SELECT k FROM t UNION SELECT k FROM o UNION SELECT k FROM v),
wo AS (SELECT ks.k, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("completed", "completed_output", "completed_prompt", "good", "good_output", "ttft_violations", "tpot_violations", "rejected", "cancelled", "failed", "emitted_0", "emitted_1", "kv_completed", "kv_bytes", "kv_failed", "prefill_scheduled", "decode_scheduled"))},
       coalesce(ttft_sum, 0) AS ttft_sum, coalesce(tpot_sum, 0) AS tpot_sum FROM ks LEFT JOIN t ON t.k = ks.k LEFT JOIN o ON o.k = ks.k LEFT JOIN v ON v.k = ks.k)"""


@query(f"{_OUTPUTS} SELECT * FROM wo")
def window_outputs(t: Tables) -> DataFrame:
    """All nineteen outputs of each window: three aggregations of different events, put side by side."""
    q = t.em.groupBy("request_id").agg(ratio(F.max("ts_ns") - F.min("ts_ns"), F.count("*") - 1).alias("_g"), F.min("ts_ns").alias("_a"), F.sum("n").alias("out"))
    rows = t.life.where("terminal_ns is not null").join(q, "request_id", "left").select(window_index("terminal_ns", WEEK).alias("k"), F.col("terminal_event").alias("e"), "input_tokens", "out", (F.col("_g") / 1e6).alias("tpot"), ((F.col("_a") - F.col("arrival_ns")) / 1e6).alias("ttft"))
    done = F.col("e") == "request_complete"
    late, slow = ~F.coalesce(F.col("ttft") <= 5e9, F.lit(False)), F.coalesce("tpot", F.lit(0.0)) > 2e9
    of = lambda c, x: F.sum(F.when(c, x))
    ends = rows.groupBy("k").agg(
        F.count_if(done).alias("completed"), of(done, F.col("out")).alias("completed_output"), of(done, F.col("input_tokens")).alias("completed_prompt"), F.count_if(done & ~late & ~slow).alias("good"), of(done & ~late & ~slow, F.col("out")).alias("good_output"),
        F.count_if(done & late).alias("ttft_violations"), F.count_if(done & slow).alias("tpot_violations"), F.round(of(done, F.coalesce("ttft", F.lit(0.0))) / 1e6, 3).alias("ttft_sum"), F.round(of(done, F.coalesce("tpot", F.lit(0.0))) / 1e6, 3).alias("tpot_sum"),
        F.count_if(F.col("e") == "request_rejected").alias("rejected"), F.count_if(F.col("e").contains("cancel")).alias("cancelled"), F.count_if(F.col("e").contains("error")).alias("failed"),
    )
    is_ = lambda c: F.sum(F.when(c, F.col("n")))
    c = F.col("component")
    tokens = t.em.groupBy(window_index("ts_ns", WEEK).alias("k")).agg(is_(c == "decode-0").alias("emitted_0"), is_(c == "decode-1").alias("emitted_1"), is_(c == "prefill").alias("prefill_scheduled"), is_(c != "prefill").alias("decode_scheduled"))
    moved = engine.transfers(engine.transfer_ranks(transfer_events(t))).where("last_complete_ns is not null")
    moved = moved.groupBy(window_index("last_complete_ns", WEEK).alias("k")).agg(F.count("*").alias("kv_completed"), F.sum("bytes").alias("kv_bytes"), F.count_if(~F.col("success")).alias("kv_failed"))
    return ends.join(tokens, "k", "full").join(moved, "k", "full").fillna(0)


_STATES = ("PREFILL_WAITING", "DECODE_WAITING", "DECODE_RUNNING")


@query(f"""{_OUTPUTS}, {AT}, sc AS (SELECT k, count(*) FILTER (WHERE state = 'PREFILL_WAITING') AS pw, {", ".join(f"count(*) FILTER (WHERE state = '{st}' AND side = {i}) AS {n}{i}" for st, n in (("DECODE_WAITING", "dw"), ("DECODE_RUNNING", "dr")) for i in (0, 1))} FROM s GROUP BY k),
rq AS (SELECT s.k, s.side, greatest(s.expected_tokens - coalesce(sum(e.n), 0), 0) AS rest FROM s LEFT JOIN em e ON e.request_id = s.request_id AND e.component <> 'prefill' AND e.ts_ns <= s.k * {WEEK} WHERE s.state = 'DECODE_RUNNING' GROUP BY s.k, s.side, s.request_id, s.expected_tokens),
rk AS (SELECT k, coalesce(sum(rest) FILTER (WHERE side = 0), 0) AS rest0, coalesce(sum(rest) FILTER (WHERE side = 1), 0) AS rest1 FROM rq GROUP BY k),
kp AS (SELECT wo.*, coalesce(rest0, 0) AS rest0, coalesce(rest1, 0) AS rest1, row_number() OVER (ORDER BY wo.k) - 1 AS i, coalesce(pw, 0) AS pw, coalesce(dw0, 0) AS dw0, coalesce(dw1, 0) AS dw1, coalesce(dr0, 0) AS dr0, coalesce(dr1, 0) AS dr1 FROM wo LEFT JOIN sc ON sc.k = wo.k LEFT JOIN rk ON rk.k = wo.k)
SELECT i // 25 AS slow, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(completed_output) AS BIGINT) AS completed_output, round(sum(completed_output) / 5.0, 6) AS throughput, round(sum(good_output) / 5.0, 6) AS goodput,
       round(sum(ttft_sum) / nullif(sum(completed), 0), 4) AS ttft_mean, round(sum(tpot_sum) / nullif(sum(completed), 0), 4) AS tpot_mean, {", ".join(f"round(CAST(sum({c}) AS DOUBLE) * CAST(0.2 AS DOUBLE), 6) AS {c}_integral" for c in ("pw", "dw0", "dw1", "dr0", "dr1", "rest0", "rest1"))}, round(CAST(sum(rest0 - rest1) AS DOUBLE) * CAST(0.2 AS DOUBLE), 6) AS rest_imbalance,
       round(CAST(sum(dw0 - dw1) AS DOUBLE) * CAST(0.2 AS DOUBLE), 6) AS dw_imbalance, round(CAST(sum(dr0 - dr1) AS DOUBLE) * CAST(0.2 AS DOUBLE), 6) AS dr_imbalance,
       CAST(sum(kv_bytes) AS BIGINT) AS kv_bytes, CAST(sum(prefill_scheduled) AS BIGINT) AS prefill_scheduled, CAST(sum(decode_scheduled) AS BIGINT) AS decode_scheduled FROM kp GROUP BY 1 HAVING count(*) = 25""")
def slow_kpis(t: Tables) -> DataFrame:
    """Windows' outputs and inventories rolled up by twenty-five: sums, rates, means, integrals over time and imbalances."""
    at = time.dense_inventory(states.intervals(t.life).where(F.col("state").isin(*_STATES)), ["state", "side"], "start_ns", "end_ns", WEEK, {"n": F.lit(1).cast("long")}, last_boundary(t))
    of = lambda state, side=None: F.sum(F.when((F.col("state") == state) & (F.lit(True) if side is None else F.col("side") == side), F.col("n")))
    counts = at.groupBy("k").agg(of("PREFILL_WAITING").alias("pw"), of("DECODE_WAITING", 0).alias("dw0"), of("DECODE_WAITING", 1).alias("dw1"), of("DECODE_RUNNING", 0).alias("dr0"), of("DECODE_RUNNING", 1).alias("dr1"))
    # what is left of each running request falls with its emissions; the sums' changes are held from boundary to boundary
    running = states.intervals(t.life).where("state = 'DECODE_RUNNING'").select("request_id", "side", "start_ns", "end_ns", "expected_tokens")
    left = vectors.falling(running, t.em.where("component <> 'prefill'").select("request_id", "ts_ns", "n"), "request_id", "expected_tokens", "n")
    rest = time.dense_inventory(left, ["side"], "start_ns", "end_ns", WEEK, {"rest": F.greatest("left", F.lit(0))}, last_boundary(t)).groupBy("k").pivot("side", [0, 1]).agg(F.sum("rest")).select("k", F.col("0").alias("rest0"), F.col("1").alias("rest1"))
    x = window_outputs(t).join(counts, "k", "left").join(rest, "k", "left").fillna(0).withColumn("_i", F.row_number().over(W.orderBy("k")) - 1)  # one row for each window of one calendar
    held = lambda c: F.round(F.sum(c).cast("double") * 0.2, 6)
    g = x.groupBy(window_index("_i", 25).alias("slow")).agg(
        F.count("*").alias("_n"), F.sum("completed").alias("completed"), F.sum("completed_output").alias("completed_output"), F.round(F.sum("completed_output") / 5.0, 6).alias("throughput"), F.round(F.sum("good_output") / 5.0, 6).alias("goodput"),
        F.round(ratio(F.sum("ttft_sum"), F.sum("completed")), 4).alias("ttft_mean"), F.round(ratio(F.sum("tpot_sum"), F.sum("completed")), 4).alias("tpot_mean"), *(held(c).alias(f"{c}_integral") for c in ("pw", "dw0", "dw1", "dr0", "dr1", "rest0", "rest1")), held(F.col("rest0") - F.col("rest1")).alias("rest_imbalance"),
        held(F.col("dw0") - F.col("dw1")).alias("dw_imbalance"), held(F.col("dr0") - F.col("dr1")).alias("dr_imbalance"), F.sum("kv_bytes").alias("kv_bytes"), F.sum("prefill_scheduled").alias("prefill_scheduled"), F.sum("decode_scheduled").alias("decode_scheduled"),
    )
    return g.where("_n = 25").drop("_n")


@query("""x AS (SELECT workload, request_id, (terminal_ns - arrival_ns) / 1e9 AS s, arrival_ns, terminal_ns, terminal_event = 'request_complete' AS ok, expected_tokens FROM life WHERE terminal_ns IS NOT NULL)
SELECT workload, count(*) AS requests, count(*) FILTER (WHERE ok) AS succeeded, round(quantile_cont(s, 0.5) FILTER (WHERE ok), 3) AS p50, round(quantile_cont(s, 0.95) FILTER (WHERE ok), 3) AS p95, round(quantile_cont(s, 0.99) FILTER (WHERE ok), 3) AS p99, round(avg(s) FILTER (WHERE ok), 3) AS mean,
       round(count(*) FILTER (WHERE ok) / ((max(terminal_ns) - min(arrival_ns)) / 1e9) * 86400, 9) AS requests_a_day, round(sum(expected_tokens) FILTER (WHERE ok) / ((max(terminal_ns) - min(arrival_ns)) / 1e9) * 86400, 6) AS tokens_a_day FROM x GROUP BY workload""")
def load_summary(t: Tables) -> DataFrame:
    """What a load test reports: successes, latency percentiles, throughput over the time it took."""
    rows = t.life.where("terminal_ns is not null").select("workload", ((F.col("terminal_ns") - F.col("arrival_ns")) / 1e9).alias("s"), "arrival_ns", "terminal_ns", (F.col("terminal_event") == "request_complete").alias("ok"), "expected_tokens")
    return vectors.load_summary(rows, ["workload"])


@query(f"""SELECT event_id, round((ts_ns % {DAY_NS}) / {float(DAY_NS)}, 9) AS phase, round(sin((ts_ns % {DAY_NS}) / {float(DAY_NS)} * 2 * pi()), 6) AS phase_sin, round(cos((ts_ns % {DAY_NS}) / {float(DAY_NS)} * 2 * pi()), 6) AS phase_cos,
       round(ln(1 + k), 6) AS log_input_tokens, round(ln(1 + k * 2), 6) AS log_expected_tokens, round(ln(1 + k * 4096), 6) AS log_kv_bytes, round(ln(1 + k // 3), 6) AS log_block_count, 0.5 AS load, CASE WHEN process % 2 = 0 THEN 1.0 ELSE 0.0 END AS mixed_bimodal,
       CASE WHEN process % 3 = 0 THEN 1.0 ELSE 0.0 END AS on_off_burst, round(ln(1 + process), 6) AS log_total_running_requests, round(ln(1 + value), 6) AS log_total_running_tokens FROM ev""")
def phase_features_all(t: Tables) -> DataFrame:
    """The whole map of twelve features, the run's factors read from its name."""
    name = F.concat(F.lit("rom-"), F.when(F.col("process") % 2 == 0, "mixed-bimodal").otherwise("balanced"), F.lit("-l50-"), F.when(F.col("process") % 3 == 0, "on_off_burst").otherwise("poisson"), F.lit("-s1"))
    rows = t.ev.withColumn("name", name).select(
        "event_id", "ts_ns", "name", F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("expected_tokens"), (F.col("k") * 4096).alias("kv_bytes"), F.expr("k div 3").alias("block_count"), F.col("process").alias("running_requests"), F.col("value").alias("running_tokens")
    )
    f = vectors.phase_map("ts_ns", DAY_NS, "name", ["input_tokens", "expected_tokens", "kv_bytes", "block_count"], ["running_requests", "running_tokens"])
    digits = {"phase": 9}
    return rows.select("event_id", *(F.round(c, digits.get(n, 6)).alias(n) for n, c in f.items()))


@query("""SELECT DISTINCT 'rom-' || CASE WHEN client % 3 = 0 THEN 'balanced' WHEN client % 3 = 1 THEN 'mixed-bimodal' ELSE 'other' END || '-l' || (client % 80) || '-poisson' AS name, CASE WHEN client % 3 = 0 THEN 'balanced' WHEN client % 3 = 1 THEN 'mixed-bimodal' ELSE 'unknown' END AS workload,
       CAST(CASE WHEN client % 3 < 2 THEN client % 80 ELSE -1 END AS INTEGER) AS load FROM att""")
def run_factors(t: Tables) -> DataFrame:
    name = F.concat(F.lit("rom-"), F.expr("CASE WHEN client % 3 = 0 THEN 'balanced' WHEN client % 3 = 1 THEN 'mixed-bimodal' ELSE 'other' END"), F.lit("-l"), F.col("client") % 80, F.lit("-poisson"))
    return t.att.select(name.alias("name")).distinct().select("name", *vectors.run_factors("name"))


_SIGN = "CASE side WHEN 0 THEN 1 WHEN 1 THEN -1 END"
#: Times of a request's stages, and its emissions signed by its side.
_SERIES = f"""{_STAGES}, sg AS (SELECT *, {_SIGN} AS g FROM st), me AS (SELECT e.request_id, e.ts_ns, e.n, s.g FROM em e JOIN sg s ON s.request_id = e.request_id WHERE e.component <> 'prefill'), fm AS (SELECT request_id, min(ts_ns) AS ts_ns FROM me GROUP BY 1),
tot AS (SELECT request_id, sum(n) AS n FROM me GROUP BY 1),
sr AS (SELECT 'running_admission' AS name, f.ts_ns AS ts, s.g AS v FROM fm f JOIN sg s ON s.request_id = f.request_id UNION ALL SELECT 'scheduled_token_service', ts_ns, g * n FROM me UNION ALL SELECT 'emitted_token_service', ts_ns, g * (n % 7) FROM me
       UNION ALL SELECT 'decode_added', admission_ns, g FROM sg UNION ALL SELECT 'active_request_inflow', route_ns, g FROM sg UNION ALL SELECT 'active_token_inflow', route_ns, g * expected_tokens FROM sg UNION ALL SELECT 'completion_outflow', terminal_ns, g FROM sg
       UNION ALL SELECT 'terminal_residual_token_outflow', s.terminal_ns, s.g * greatest(s.expected_tokens - coalesce(tot.n, 0), 0) FROM sg s LEFT JOIN tot ON tot.request_id = s.request_id UNION ALL SELECT 'kv_ready_transition', ready_ns, g FROM sg)"""


@query(f"{_SERIES} SELECT ts // {WEEK} AS k, name, CAST(sum(v) AS BIGINT) AS v FROM sr GROUP BY ALL")
def outflow_series(t: Tables) -> DataFrame:
    """The nine signed flow series (first decoder less second) by window; windows without a flow have no row."""
    g = F.expr(_SIGN)
    rows = staged(t).withColumn("g", g)
    members = t.em.where("component <> 'prefill'").select("request_id", "ts_ns", "n").join(rows.select("request_id", "g"), "request_id")
    totals = members.groupBy("request_id").agg(F.sum("n").alias("_n"), F.min("ts_ns").alias("_first"))
    whole = rows.join(totals, "request_id", "left")
    residual = F.greatest(F.col("expected_tokens") - F.coalesce("_n", F.lit(0)), F.lit(0))
    one = lambda name, ts, v: F.struct(F.lit(name).alias("name"), F.col(ts).alias("ts"), v.cast("long").alias("v"))
    of_request = F.array(
        one("running_admission", "_first", F.col("g")), one("decode_added", "admission_ns", F.col("g")), one("active_request_inflow", "route_ns", F.col("g")), one("active_token_inflow", "route_ns", F.col("g") * F.col("expected_tokens")),
        one("completion_outflow", "terminal_ns", F.col("g")), one("terminal_residual_token_outflow", "terminal_ns", F.col("g") * residual), one("kv_ready_transition", "ready_ns", F.col("g")),
    )
    of_member = F.array(one("scheduled_token_service", "ts_ns", F.col("g") * F.col("n")), one("emitted_token_service", "ts_ns", F.col("g") * (F.col("n") % 7)))
    series = whole.select(F.explode(of_request).alias("x")).unionByName(members.select(F.explode(of_member).alias("x"))).where("x.ts is not null")
    return series.groupBy(window_index("x.ts", WEEK).alias("k"), F.col("x.name").alias("name")).agg(F.sum("x.v").alias("v"))


#: What changes the inventories of running requests and of tokens that are left, by closure: the stock, its inflow, its outflows.
_CLOSE = {"request": ("requests", "running_admission", "completion_outflow"), "routed_token": ("tokens", "routed_token_inflow", "emitted_token_service", "terminal_residual"), "active_token": ("tokens", "active_token_inflow", "emitted_token_service", "terminal_residual")}


@query(f"""{_STAGES}, sg AS (SELECT *, {_SIGN} AS g FROM st), me AS (SELECT s.request_id, s.g, e.ts_ns, e.n % 7 AS e FROM em e JOIN sg s ON s.request_id = e.request_id WHERE e.component <> 'prefill' AND e.ts_ns >= route_ns AND e.ts_ns < terminal_ns),
pr AS (SELECT sg.*, f.first, coalesce(f.gone, 0) AS gone FROM sg LEFT JOIN (SELECT request_id, min(ts_ns) AS first, sum(e) AS gone FROM me GROUP BY 1) f USING (request_id)),
fl AS (SELECT 'running_admission' AS name, first AS ts, g AS v FROM pr WHERE first IS NOT NULL UNION ALL SELECT 'completion_outflow', terminal_ns, g FROM pr WHERE first IS NOT NULL UNION ALL SELECT 'routed_token_inflow', ready_ns, g * expected_tokens FROM pr
       UNION ALL SELECT 'active_token_inflow', route_ns, g * expected_tokens FROM pr UNION ALL SELECT 'emitted_token_service', ts_ns, g * e FROM me UNION ALL SELECT 'terminal_residual', terminal_ns, g * (expected_tokens - gone) FROM pr),
fk AS (SELECT name, (ts + {WEEK - 1}) // {WEEK} - 1 AS k, sum(v) AS v FROM fl GROUP BY ALL), ks AS (SELECT unnest(generate_series(min(k), max(k))) AS k FROM fk), bs AS (SELECT k FROM ks UNION SELECT k + 1 FROM ks),
q AS (SELECT k, coalesce((SELECT sum(g) FROM pr WHERE first <= k * {WEEK} AND k * {WEEK} < terminal_ns), 0) AS requests,
      coalesce((SELECT sum(g * expected_tokens) FROM pr WHERE route_ns <= k * {WEEK} AND k * {WEEK} < terminal_ns), 0) - coalesce((SELECT sum(g * e) FROM me JOIN pr USING (request_id, g) WHERE ts_ns <= k * {WEEK} AND k * {WEEK} < terminal_ns), 0) AS tokens FROM bs),
d AS (SELECT a.k, CAST(b.requests - a.requests AS DOUBLE) AS requests, CAST(b.tokens - a.tokens AS DOUBLE) AS tokens FROM q a JOIN q b ON b.k = a.k + 1 JOIN ks ON ks.k = a.k),
c AS ({" UNION ALL ".join(f"SELECT '{n}' AS closure, d.k, {stock} AS d, coalesce((SELECT sum(CASE WHEN name = '{i}' THEN v ELSE -v END) FROM fk WHERE fk.k = d.k AND name IN ({', '.join(repr(x) for x in (i, *outs))})), 0) AS p FROM d" for n, (stock, i, *outs) in _CLOSE.items())})
SELECT closure, count(*) AS rows, round(avg(d - p), 6) AS residual_mean, round(stddev_pop(d - p), 5) AS residual_std, round(sqrt(sum((d - p) * (d - p)) / greatest(sum(d * d), 1e-30)), 6) AS nrmse, round(avg(CASE WHEN abs(d - p) < 1e-9 THEN 1.0 ELSE 0.0 END), 9) AS exact FROM c GROUP BY closure""")
def conservation_closures(t: Tables) -> DataFrame:
    """Three closures of the change of an inventory, which comes from the requests' intervals, against the flows that should make it.

    A request runs from its first emission to its end; what is left of it falls with each emission in between. Tokens are
    booked as routed once they are ready, and as active once the request is: only the second closes.
    """
    rows = staged(t).withColumn("g", F.expr(_SIGN))
    members = t.em.where("component <> 'prefill'").select("request_id", "ts_ns", (F.col("n") % 7).alias("e")).join(rows, "request_id").where("ts_ns >= route_ns and ts_ns < terminal_ns").select("request_id", "g", "ts_ns", "e", "terminal_ns", "expected_tokens")
    per = members.groupBy("request_id").agg(F.min("ts_ns").alias("first"), F.sum("e").alias("gone"))
    whole = rows.join(per, "request_id", "left").fillna(0, ["gone"])
    one = lambda name, ts, v: F.struct(F.lit(name).alias("name"), F.col(ts).alias("ts"), v.cast("long").alias("v"))
    g, ran = F.col("g"), F.col("first").isNotNull()
    of_request = F.array(
        one("running_admission", "first", g), F.when(ran, one("completion_outflow", "terminal_ns", g)), one("routed_token_inflow", "ready_ns", g * F.col("expected_tokens")),
        one("active_token_inflow", "route_ns", g * F.col("expected_tokens")), one("terminal_residual", "terminal_ns", g * (F.col("expected_tokens") - F.col("gone"))),
    )
    moved = whole.select(F.explode(of_request).alias("x")).unionByName(members.select(one("emitted_token_service", "ts_ns", g * F.col("e")).alias("x"))).where("x.ts is not null").select("x.*")
    left = vectors.falling(whole.select("request_id", "g", F.col("route_ns").alias("start_ns"), F.col("terminal_ns").alias("end_ns"), "expected_tokens"), members.select("request_id", "ts_ns", "e"), "request_id", "expected_tokens", "e")
    stocks = {
        "requests": time.inventory(whole, [], "first", "terminal_ns", WEEK, {"q": g}),
        "tokens": time.inventory(left, [], "start_ns", "end_ns", WEEK, {"q": g * F.col("left")}),
    }
    return vectors.closures(vectors.balances(stocks, moved, _CLOSE, WEEK))


#: Seven flows of two quantities; tokens that are emitted leave the stage that their request is in.
_FLOW7 = f"""{_STAGES}, es AS (SELECT s.side, s.request_id, e.ts_ns, e.n % 7 AS n, CASE WHEN e.ts_ns >= route_ns AND e.ts_ns < ready_ns THEN 'handoff' WHEN e.ts_ns >= ready_ns AND e.ts_ns < admission_ns THEN 'waiting' WHEN e.ts_ns >= admission_ns AND e.ts_ns < terminal_ns THEN 'running' END AS stage FROM em e JOIN st s ON s.request_id = e.request_id),
lf AS ({" UNION ALL ".join(f"SELECT s.side, '{f}' AS flow, s.{c} AS ts, s.request_id, s.expected_tokens - coalesce((SELECT sum(n % 7) FROM em e WHERE e.request_id = s.request_id AND e.ts_ns < s.{c} AND e.ts_ns >= s.route_ns), 0) AS rest FROM st s" for f, c in (("route", "route_ns"), ("kv_ready", "ready_ns"), ("admission", "admission_ns"), ("terminal", "terminal_ns")))})"""


@query(f"""{_FLOW7}, x AS (SELECT side, flow, (ts + {WEEK - 1}) // {WEEK} AS k, 1 AS requests, rest AS tokens FROM lf UNION ALL SELECT side, 'service_' || stage, ts_ns // {WEEK} + 1, 0, n FROM es WHERE stage IS NOT NULL)
SELECT side, flow, k, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM x GROUP BY ALL""")
def stage_flows_all(t: Tables) -> DataFrame:
    """Seven flows in requests and in expected tokens that are left: four between stages, and service within each of the three."""
    st = staged(t)
    em = t.em.select("request_id", "ts_ns", (F.col("n") % 7).alias("n")).join(st, "request_id")
    seen = em.where("ts_ns >= route_ns").groupBy("request_id").agg(*(F.coalesce(F.sum(F.when(F.col("ts_ns") < F.col(c), F.col("n"))), F.lit(0)).alias(f"_{c}") for c in ("route_ns", "ready_ns", "admission_ns", "terminal_ns")))
    rows = st.join(seen, "request_id", "left").fillna(0, ["_route_ns", "_ready_ns", "_admission_ns", "_terminal_ns"])
    times = F.array(*(F.struct(F.lit(n).alias("flow"), (-window_index(-F.col(c), WEEK)).alias("k"), F.lit(1).cast("long").alias("requests"), (F.col("expected_tokens") - F.col(f"_{c}")).alias("tokens")) for n, c in (("route", "route_ns"), ("kv_ready", "ready_ns"), ("admission", "admission_ns"), ("terminal", "terminal_ns"))))
    moves = rows.select("side", F.explode(times).alias("x")).select("side", "x.*")
    service = em.withColumn("stage", states.stage()).where("stage is not null").select("side", F.concat(F.lit("service_"), "stage").alias("flow"), boundary_after("ts_ns", WEEK).alias("k"), F.lit(0).cast("long").alias("requests"), F.col("n").alias("tokens"))
    return moves.unionByName(service).groupBy("side", "flow", "k").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))


@query(f"""{_STAGES}, fl AS ({" UNION ALL ".join(f"SELECT side, '{s}' AS stage, ({c} + {WEEK - 1}) // {WEEK} AS k, {v} AS d FROM st WHERE request_id % 50 <> 0" for s, c, v in (("handoff", "route_ns", 1), ("handoff", "ready_ns", -1), ("waiting", "ready_ns", 1), ("waiting", "admission_ns", -1), ("running", "admission_ns", 1), ("running", "terminal_ns", -1)))}),
iv AS ({" UNION ALL ".join(f"SELECT side, '{s}' AS stage, ({a} + {WEEK - 1}) // {WEEK} AS a, ({b} + {WEEK - 1}) // {WEEK} AS b FROM st" for s, a, b in (("handoff", "route_ns", "ready_ns"), ("waiting", "ready_ns", "admission_ns"), ("running", "admission_ns", "terminal_ns")))}),
r AS (SELECT side, stage, min(a) AS lo, max(b) AS hi FROM iv GROUP BY side, stage), g AS (SELECT side, stage, unnest(generate_series(lo, hi)) AS k FROM r),
x AS (SELECT g.stage, (SELECT count(*) FROM iv WHERE iv.side = g.side AND iv.stage = g.stage AND a <= g.k AND g.k < b) AS actual, (SELECT coalesce(sum(d), 0) FROM fl WHERE fl.side = g.side AND fl.stage = g.stage AND fl.k <= g.k) AS predicted FROM g)
SELECT stage, count(*) AS n, round(sqrt(sum((predicted - actual) * (predicted - actual)) / greatest(sum(actual * actual), 1e-30)), 9) AS nrmse, round(count(*) FILTER (WHERE predicted = actual) / count(*), 9) AS exact FROM x GROUP BY stage""")
def replay_metrics(t: Tables) -> DataFrame:
    """Stage inventories replayed from flows that lack every fiftieth request: normalised error and exact share over all windows."""
    moves = F.array(*(F.struct(F.lit(s).alias("stage"), (-window_index(-F.col(c), WEEK)).alias("k"), F.lit(v).alias("d")) for s, c, v in (("handoff", "route_ns", 1), ("handoff", "ready_ns", -1), ("waiting", "ready_ns", 1), ("waiting", "admission_ns", -1), ("running", "admission_ns", 1), ("running", "terminal_ns", -1))))
    net = staged(t).where("request_id % 50 <> 0").select("side", F.explode(moves).alias("x")).groupBy("side", "x.stage", "x.k").agg(F.sum("x.d").alias("d"))
    return vectors.replayed(net, stage_inventory(t), ["side", "stage"], "k", "d", "n").select("stage", "n", F.round("nrmse", 9).alias("nrmse"), F.round("exact", 9).alias("exact"))


@query(f"""{_WEEKLY}, r AS (SELECT run, n, tokens, row_number() OVER (PARTITION BY run ORDER BY k) AS i FROM wk),
c AS (SELECT a.run, l.lag, corr(a.n, b.tokens) AS c FROM r a, (SELECT unnest(generate_series(-25, 25)) AS lag) l, r b WHERE b.run = a.run AND b.i = a.i + l.lag GROUP BY a.run, l.lag),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY -round(abs(c), 9), abs(lag), lag) AS p FROM c WHERE c IS NOT NULL AND NOT isnan(c)) SELECT run, CAST(lag AS INTEGER) AS lag, round(c, 6) AS corr FROM o WHERE p = 1""")
def lag_of_best(t: Tables) -> DataFrame:
    return time.lag_of_best(weekly(t), ["run"], "k", "n", "tokens", 25).select("run", "lag", F.round("corr", 6).alias("corr"))


@query(f"""{_STAY}, n AS (SELECT side, greatest(CAST(ceil((b - a) / {float(DAY_NS)}) AS BIGINT), 1) AS n FROM sy), g AS (SELECT side, n, unnest(generate_series(0, n - 1)) AS s FROM n),
h AS (SELECT side, CASE WHEN s < 2 THEN 0 WHEN s < 5 THEN 1 WHEN s < 9 THEN 2 ELSE 3 END AS bin, (count(*) FILTER (WHERE s = n - 1) + 0.5) / (count(*) + 1.0) AS h FROM g GROUP BY ALL),
ag AS (SELECT DISTINCT side, age, CASE WHEN age < 2 THEN 0 WHEN age < 5 THEN 1 WHEN age < 9 THEN 2 ELSE 3 END AS bin FROM sy, (SELECT unnest(generate_series(0, 20)) AS age) z)
SELECT ag.side, CAST(ag.age AS INTEGER) AS age, round(coalesce(exp(sum(ln(1 - h.h)) OVER (PARTITION BY ag.side ORDER BY ag.age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1), 6) AS predicted,
       round((SELECT count(*) FILTER (WHERE (y.b - y.a) / {float(DAY_NS)} > ag.age) / count(*) FROM sy y WHERE y.side = ag.side), 9) AS empirical FROM ag JOIN h ON h.side = ag.side AND h.bin = ag.bin""")
def survival_calibration(t: Tables) -> DataFrame:
    """The product of 1 - hazard against the share of stays that are longer."""
    h = survival.hazard(staged(t), ["side"], "ready_ns", "admission_ns", "expected_tokens", _EDGES, DAY_NS, 0.5)
    predicted = survival.hazard_by_step(h, ["side"], _EDGES, 20).select("side", "age", F.round("alive", 6).alias("predicted"))
    observed = survival.survival(staged(t), ["side"], "ready_ns", "admission_ns", DAY_NS, 20).select("side", F.col("age").cast("int").alias("age"), F.round("alive", 9).alias("empirical"))
    return predicted.join(observed, ["side", "age"])
