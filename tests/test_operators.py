"""Single operators on small tables: half-open ownership, conservation, isolation, recovery of parameters, faults."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import bin_equal, bin_irregular, boundary_after, boundary_at_or_after, or_else, seed_of, side_of, window_index
from tidemark.operators import engine, events, linear, snapshots, states, stats, survival, time, vectors, workloads
from tidemark.sources import logs


def values(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_window_and_boundary_ownership(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (10,), (11,)], "t long")
    got = values(df.select("t", window_index("t", 10).alias("w"), boundary_at_or_after("t", 10).alias("b"), boundary_after("t", 10).alias("a")), "t")
    assert got == [(-1, -1, 0, 0), (0, 0, 0, 1), (5, 0, 1, 1), (10, 1, 1, 2), (11, 1, 2, 2)]


def test_bins(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.2,), (9.0,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(bin_irregular("v", [0.0, 0.2, 0.4, float("inf")])).collect()] == [2, 0, 1, 2, 2, None]
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (512,), (10000,), (None,), (-5,)], "v long").select(bin_equal("v", 512, 256)).collect()] == [0, 0, 2, 2, 0, 0]


def test_zero_counts_as_missing_and_sides(spark):
    df = spark.createDataFrame([(0, 3, "h:13701"), (None, 4, "h:13702"), (2, 5, "h:1")], "a long, b long, e string")
    assert values(df.select(or_else("a", "b"), side_of("e"))) == [(3, 0), (4, 1), (2, None)]
    assert int(df.select(seed_of(F.lit("a"), F.lit("b")).alias("s")).first()[0]) == workloads.seed("a", "b")


GUARDS = ["arrival_ns", "submit_ns", "prefill_scheduled_ns", "prefill_added_ns", "prefill_terminal_ns", "prefill_complete_ns", "kv_enqueue_ns", "kv_start_ns", "kv_ready_ns", "decode_added_ns", "decode_scheduled_ns", "terminal_ns"]


def ladder(r, t):
    """One request's state at one time, guard by guard."""
    if r["arrival_ns"] is None or t < r["arrival_ns"]:
        return None
    if r["terminal_ns"] is not None and t >= r["terminal_ns"]:
        return None
    if r["terminal_event"] == "request_rejected" or not r["accepted"]:
        return "ADMITTED"
    ways = [r["submit_ns"], r["prefill_scheduled_ns"] or r["prefill_added_ns"], r["prefill_terminal_ns"] or r["prefill_complete_ns"], r["kv_enqueue_ns"], r["kv_start_ns"], r["kv_ready_ns"], r["decode_added_ns"], r["decode_scheduled_ns"] or r["decode_added_ns"]]
    state = 0
    for g in ways:
        if g is None or t < g:
            break
        state += 1
    return states.STATES[state]


def test_intervals_equal_the_ladder(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        r = {g: rng.choice([None, rng.randrange(1, 90)]) if rng.random() < 0.25 else rng.randrange(1, 90) for g in GUARDS}
        rows.append(r | {"request_id": i, "accepted": rng.random() < 0.9, "terminal_event": rng.choice(["request_complete", "request_rejected", "request_error"])})
    df = spark.createDataFrame(rows, ", ".join(f"{g} long" for g in GUARDS) + ", request_id long, accepted boolean, terminal_event string")
    got = {(r.request_id, r.k): r.state for r in states.at_boundaries(df, 10, 0, 10).collect()}
    want = {(r["request_id"], k): s for r in rows for k in range(11) if (s := ladder(r, 10 * k))}
    assert got == want


def test_reasons_are_given_only_for_the_blocking_guard(spark):
    base = dict.fromkeys(GUARDS, 1) | {"request_id": 1, "accepted": True, "terminal_event": "request_complete", "kv_start_ns": None, "kv_ready_ns": None, "terminal_ns": 50}
    df = spark.createDataFrame([base], ", ".join(f"{g} long" for g in GUARDS) + ", request_id long, accepted boolean, terminal_event string")
    assert values(states.intervals(df).select("state", "end_ns", "reason")) == [("KV_QUEUED", 50, "kv_start_missing")]


def test_as_of_and_nearest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 7, 3)], "k string, u long, v int")
    assert values(time.as_of(left, right, ["k"], "t", "u", ["v"], ["v"]), "k", "t") == [("a", 5, 2), ("a", 10, 3), ("b", 1, None)]
    assert values(time.as_of(left, right, ["k"], "t", "u", ["v"], ["v"], strict=True), "k", "t") == [("a", 5, None), ("a", 10, 3), ("b", 1, None)]
    assert values(time.nearest(left, right.select("k", "u"), ["k"], "t", "u"), "k", "t") == [("a", 5, 0), ("a", 10, 3), ("b", 1, None)]


def test_memory_stays_within_a_run(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(4)] + [("b", i, 10.0 + i) for i in range(3)], "run string, k long, x double")
    a = np.exp(-0.5)
    want = {}
    for run, xs in (("a", [0.0, 1.0, 2.0, 3.0]), ("b", [10.0, 11.0, 12.0])):
        m = xs[0]
        for k, x in enumerate(xs):
            want[run, k] = m
            m = a * m + (1 - a) * x
    got = {(r.run, r.k): r.memory for r in time.ewma(df, ["run"], "k", "x", 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert values(time.lagged(df, ["run"], "k", "x", 1).where("k = 0").select("run", "x_lag1"), "run") == [("a", 0.0), ("b", 10.0)]


def test_block_sum_conserves_and_drops_the_rest(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(7)], "run string, k long, n long")
    assert values(time.block_sum(df, ["run"], "k", 3, ["n"]), "block") == [("a", 0, 3), ("a", 1, 12)]


def test_sequence_rules(spark):
    df = spark.createDataFrame([("r", "p", s) for s in (1, 2, 2, 5)], "run_id string, process string, seq long")
    assert values(events.sequence_gaps(df)) == [("r", "p", 5, 4, 2, 1)]
    assert values(events.sequence_jumps(df), "seq") == [("r", "p", 2, 3), ("r", "p", 5, 3)]


def event(kind, t, attempt=0, request="q0", trace="t0", payload="{}", seq=None):
    return ("run", trace, attempt, request, "x", "proc", kind, t, t, seq or t, payload)


EVENT = "run_id string, trace_id string, attempt_id int, request_id string, external_request_id string, process_instance_id string, event_type string, ts_mono_ns long, ts_wall_ns long, event_seq long, payload string"
GOOD = ["request_arrival", "admission_decision", "prefill_http_submit", "prefill_http_complete", "p_to_d_route", "decode_http_submit", "decode_first_byte", "request_complete"]


def codes(spark, rows):
    return sorted(r.code for r in events.lifecycle_violations(spark.createDataFrame(rows, EVENT)).collect())


def test_lifecycle_rules(spark):
    good = [event(k, i + 1, payload='{"accepted": true}') for i, k in enumerate(GOOD)]
    assert codes(spark, good) == []
    assert codes(spark, good + [event("request_error", 20)]) == ["duplicate_terminal_event"]
    assert codes(spark, [e for e in good if e[6] != "prefill_http_submit"]) == ["prefill_complete_without_submit"]
    assert codes(spark, good[:-1]) == ["accepted_request_without_terminal_state", "terminal_event_missing"]
    assert codes(spark, good + [event("backend_retry", 5, attempt=2)]) == ["attempt_id_gap", "request_id_reused_across_attempts"]
    swapped = [event("p_to_d_route", 3) if e[6] == "p_to_d_route" else e for e in good]
    assert "event_order_violation" in codes(spark, swapped)
    row = events.attempts(spark.createDataFrame(good, EVENT)).first()
    assert (row.request_id, row.prefill_submit_mono_ns, row.decode_first_byte_mono_ns, row.terminal_event, row.event_count) == ("q0", 3, 7, "request_complete", 8)


def test_transfer_ranks_and_missing_ranks(spark):
    rows = [("r", "c", "d", rank, 2, kind, *(t if kind == k else None for k in ("enqueued", "started", "completed")), 4, 1024 if kind == "completed" else None) for rank in (0, 1) for kind, t in (("enqueued", 200), ("started", 210), ("completed", 230 + rank))]
    schema = "request_id string, component string, target string, tp_rank int, tp_size int, event_type string, enqueue_ns long, start_ns long, complete_ns long, blocks long, bytes long"
    whole = engine.transfers(engine.transfer_ranks(spark.createDataFrame(rows, schema))).first()
    assert (whole.bytes, whole.missing, whole.ready_ns, whole.success) == (2048, [], 231, True)
    part = engine.transfers(engine.transfer_ranks(spark.createDataFrame([r for r in rows if r[3] == 0], schema))).first()
    assert (part.missing, part.ready_ns, part.success) == ([1], None, False)


def test_percentiles_and_effects(spark):
    df = spark.createDataFrame([(x, x % 2) for x in (1, 2, 3, 4)], "x int, g int")
    assert df.agg(stats.pct_floor("x", 0.5), stats.pct_linear("x", 0.5)).first() == (2, 2.5)
    assert values(stats.pct_floor_by(df, [], "x", [0.5, 1.0], ["a", "b"])) == [(2, 4)]
    effect = stats.cohen_d(df, [], "g", "x", 0, 1).first().effect
    assert effect == pytest.approx(-1 / np.sqrt(2))
    assert df.withColumn("c", F.lit(1)).agg(stats.pearson("x", "c")).first()[0] is None


def test_step_analysis(spark):
    u, v = [0.3] * 4 + [0.7] * 6, [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 3.0]
    df = spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate(zip(u, v, strict=True))], "run string, k long, u double, y double")
    row = stats.steps(df, ["run"], "k", "u", "y").first()
    assert (row["at"], row.baseline, row.plateau, row.direction_correct, row.response_delay, row.settling_time) == (4, 1.0, 3.0, True, 5.0, 10.0)


def test_fallback_median(spark):
    levels = [["a", "b"], ["a"], []]
    medians = stats.stratified_median(spark.createDataFrame([("x", 1, 20), ("x", 1, 40), ("y", 1, 100)], "a string, b int, v int"), "v", levels)
    df = spark.createDataFrame([("x", 1), ("x", 2), ("z", 1)], "a string, b int")
    assert values(stats.with_fallback(df, medians, levels).select("a", "b", "predicted"), "a", "b") == [("x", 1, 30.0), ("x", 2, 30.0), ("z", 1, 40.0)]


def test_models_recover_their_parameters(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    y = x @ np.array([[1.0, 0], [2, 1], [0, -1]]) + [0.5, -0.5]
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    m = linear.ridge(df, "x", "y", 1e-9)
    assert np.allclose(m(x), y, atol=1e-6)
    odd = linear.symmetric_ridge(df.withColumn("y", F.transform("x", lambda v: v * 2)), "x", "y", 1e-9)
    assert np.allclose(odd(-x), -odd(x)) and np.allclose(odd(x), 2 * x, atol=1e-6)
    g, n = linear.gram(df, "x")
    assert n == 200 and np.allclose(g, x.T @ x)
    d = linear.pod(df, "x", 3)
    assert np.allclose(d.basis @ d.basis.T, np.eye(3)) and linear.captured(d, [3])[0][1] == pytest.approx(1)
    assert linear.spectral_radius(np.diag([0.5, -0.9])) == pytest.approx(0.9)


def test_rollout_is_free_and_stops(spark):
    rows = [("a", k, [1.0], [0.0]) for k in range(4)] + [("b", k, [1e5], [1.0]) for k in range(3)]
    df = spark.createDataFrame(rows, "run string, k long, z array<double>, d array<double>")
    m = linear.Ridge(np.array([[0.0], [20.0], [0.0]]))
    got = {(r.run, r.k): r.predicted for r in linear.rollout(df, "run", "k", "z", "d", m).collect()}
    assert got["a", 3] == [8000.0] and got["b", 0] == [1e5] and got["b", 1] is None and got["b", 2] is None


def test_cohorts_follow_a_walk_by_windows(spark):
    edges, rates, ages = [0.0, 1.0, 3.0, float("inf")], {0: 0.5, 1: 0.25, 2: 0.1}, 4
    inflow = {(0, 0): 8.0, (0, 1): 4.0, (0, 5): 2.0, (1, 2): 10.0}
    hazards = spark.createDataFrame([(side, b, h) for side in (0, 1) for b, h in rates.items()], "side int, bin int, hazard double")
    steps = survival.hazard_by_step(hazards, ["side"], edges, ages)
    windows = spark.createDataFrame([(0, 0, 40), (1, 0, 40)], "side int, lo long, hi long")
    got = {(r.side, r.k): (r.stock, r.outflow) for r in survival.cohorts(spark.createDataFrame([(s, k, n) for (s, k), n in inflow.items()], "side int, k long, n double"), steps, ["side"], windows).collect()}
    for side in (0, 1):
        by_age = [0.0] * (ages + 1)
        for k in range(41):
            stock = sum(by_age)
            by_age[0] += inflow.get((side, k), 0.0)
            h = [rates[0 if a < 1 else 1 if a < 3 else 2] for a in range(ages + 1)]
            left = sum(x * y for x, y in zip(by_age, h, strict=True))
            assert got[side, k] == pytest.approx((stock, left), abs=1e-9)
            stay = [x * (1 - y) for x, y in zip(by_age, h, strict=True)]
            by_age = [0.0, *stay[: ages - 1], stay[ages - 1] + stay[ages]]


def test_scan_equals_the_recurrence(spark):
    rng = np.random.default_rng(3)
    for decay in (0.0, 0.3, 0.999, 1.0):
        x = rng.standard_normal(700)
        df = spark.createDataFrame([(None, i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)], "g string, k long, x double")
        got = [r.m for r in time.scan(df, ["g"], "k", decay, F.col("x"), "m").where("g is null").orderBy("k").collect()]
        m, want = 0.0, []
        for v in x:
            m = decay * m + v
            want.append(m)
        assert np.allclose(got, want, atol=1e-9)


def test_percentiles_of_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 2 else g, float(v)) for g in range(3) for v in rng.integers(0, 30, 41)] + [(7, None)]
    got = {r.g: r for r in stats.percentiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g in (None, 0, 1):
        x = [v for k, v in rows if k == g]
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(list(np.percentile(x, [0, 37, 100])))
    assert got[7].b is None


def test_age_edges():
    # nought, one and two steps always; quantiles rounded up to whole steps; at least four finite edges, seven at most
    assert survival.age_edges(0.3, 0.31, 0.9, 1.0, 0.2) == pytest.approx([0.0, 0.2, 0.4, 1.0, float("inf")])
    assert survival.age_edges(0.1, 0.1, 0.1, 0.1, 0.2) == pytest.approx([0.0, 0.2, 0.4, 0.6, float("inf")])
    assert survival.age_edges(1.0, 2.0, 3.0, 4.0, 0.2) == pytest.approx([0.0, 0.2, 0.4, 1.0, 2.0, 3.0, 4.0, float("inf")])


def test_log_lines_are_checked(spark):
    good = {f.split()[0]: 1 if f.split()[1] in ("bigint", "int") else "a" for f in logs.ENVELOPE.split(", ")} | {"schema_version": "telemetry.v1", "payload": {}, "trace_id": None}
    lines = [good, good | {"schema_version": "other"}, good | {"attempt_id": -1}, {k: v for k, v in good.items() if k != "request_id"}, good | {"event_seq": 0}, good | {"payload": "x"}, good | {"run_id": None}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{bad",)], "value string")
    assert [r.damage for r in logs.event_rows(df, "telemetry.v1").collect()] == [None, "unsupported_schema_version", "attempt_negative", "field_missing", "sequence_not_positive", "payload_not_object", "field_missing", "not_json"]


def test_snapshot_rules(spark):
    rows = [("r", 0, 0, 10, [1.0], [2.0], 2.0, 1.0, 0.0), ("r", 1, 10, 20, [2.0], [3.0], 3.0, 0.0, 1.0), ("r", 3, 20, 31, [float("nan")], [1.0], 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "run_id string, window_id long, start_ns long, end_ns long, x array<double>, x_next array<double>, active double, arrivals double, done double")
    found = snapshots.all_of(snapshots.numbers(df, "x"), snapshots.contiguity(df, 10), snapshots.shift(df), snapshots.stock_flow(df, "active", ["arrivals"], ["done"]))
    assert sorted(r.code for r in found.collect()) == ["next_state_shift_mismatch", "numeric_nan", "request_inventory_conservation", "window_index_gap", "window_period_mismatch"]


def test_workloads():
    assert [x for _, x in workloads.schedule("step", 9, (0.3, 0.5, 0.7), 3, 1)] == [0.3, 0.5, 0.7]
    assert workloads.schedule("prbs", 60, (0.3, 0.7), 5, 7) == workloads.schedule("prbs", 60, (0.3, 0.7), 5, 7)
    n = len(list(workloads.arrivals(workloads.rate("poisson", 5, 200), 5, 200, 3)))
    assert 850 < n < 1150 and len(workloads.matrix({"a": [1, 2], "b": [1, 2, 3]})) == 6


def test_rates(spark):
    for kind, want in {"step-up": [0.6, 0.6, 1.7, 1.7], "step-down": [1.7, 1.7, 0.8, 0.8], "ramp-up": [0.6, 0.925, 1.25, 1.9], "held-out-composite": [1.8, 1.8, 1.0, 1.6], "on_off_burst": [4.0, 0.0, 4.0, 4.0]}.items():
        at = workloads.rate(kind, 2.0, 20.0)
        got = [at(t) for t in (0, 5, 10, 20)]
        assert got == pytest.approx(want), kind
        df = spark.createDataFrame([(float(t),) for t in (0, 5, 10, 20)], "t double")
        assert [r[0] for r in df.select(workloads.rate_column(F.col("t"), kind, 2.0, 20.0)).collect()] == pytest.approx(want), kind
    with pytest.raises(ValueError, match="average"):
        workloads.rate("on_off_burst", 1.0, 10.0, multiplier=1.8)


def test_damaged_flows_leave_a_residual(spark):
    spans = spark.createDataFrame([(1, 3, 25), (2, 10, 31), (3, 12, 18)], "id long, a long, b long")
    rows = [("in", t, 1) for t in (3, 10, 12)] + [("out", t, 1) for t in (25, 31, 18)]
    stocks = {"n": time.inventory(spans, [], "a", "b", 10, {"q": F.lit(1).cast("long")})}
    moved = lambda r: spark.createDataFrame(r, "name string, ts long, v long")
    of = {"c": ("n", "in", "out")}
    found = lambda r: vectors.closures(vectors.balances(stocks, moved(r), of, 10)).first()
    good = found(rows)
    assert (good.rows, good.nrmse, good.exact) == (4, 0.0, 1.0)
    bad = found(rows[1:])
    assert bad.exact == 0.75 and bad.nrmse > 0
    left = vectors.falling(spark.createDataFrame([(1, 3, 25, 9)], "id long, start_ns long, end_ns long, total long"), spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 20, 4)], "id long, ts_ns long, n long"), "id", "total", "n")
    assert sorted((r.start_ns, r.end_ns, r.left) for r in left.collect()) == [(3, 5, 9), (5, 20, 6), (20, 25, 2)]
