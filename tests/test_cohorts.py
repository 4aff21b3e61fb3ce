"""Cohort cascades and attribution against loops over ages and requests."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution, survival

EDGES = [0, 1, 3, float("inf")]


def walked(h, feed, initial, lo, hi):
    """{k: (stock, outflow, {age: mass})} of one stage, an age at a time; the last hazard stays."""
    last, at = max(h), {}
    for age, mass in initial:
        at[min(age, last)] = at.get(min(age, last), 0.0) + mass
    out = {}
    for k in range(lo, hi + 1):
        stock = dict(at)
        at[0] = at.get(0, 0.0) + feed.get(k, 0.0)
        left = {a: m * h[min(a, last)] for a, m in at.items()}
        out[k] = (sum(stock.values()), sum(left.values()), stock)
        at = {a + 1: m - left[a] for a, m in at.items()}
    return out


def test_cascade_equals_a_walk(spark):
    rng = random.Random(4)
    hazards = {n: {("x", a): rng.choice((0.0, 0.2, 0.5)) for a in range(6)} | {("y", a): v for a, v in enumerate(ages)} for n, ages in (("one", (0.1, 0.0, 0.3, 1.0, 0.2, 0.4)), ("two", (0.0, 0.5, 0.1, 0.2, 0.9, 0.0)))}
    steps = {}
    for name, h in hazards.items():
        rows, alive = [], {}
        for (key, age), v in sorted(h.items()):
            rows.append((key, age, v, alive.get(key, 1.0)))
            alive[key] = alive.get(key, 1.0) * (1 - v)
        steps[name] = spark.createDataFrame(rows, "key string, age int, h double, alive double")
    feed = {key: {k: float(rng.randrange(9)) for k in range(10, 30) if rng.random() < 0.7} for key in "xy"}
    initial = {"one": {"x": [(1, 4.0), (9, 2.0), (9, 1.0)], "y": [(2, 3.0), (5, 2.5)]}, "two": {"x": [(3, 7.0)], "y": []}}
    inflow = spark.createDataFrame([(key, k, v) for key, x in feed.items() for k, v in x.items()], "key string, k long, n double")
    windows = spark.createDataFrame([("x", 10, 40), ("y", 10, 33)], "key string, lo long, hi long")
    start = {n: spark.createDataFrame([(key, a, m) for key, x in of.items() for a, m in x], "key string, age int, n double") for n, of in initial.items()}
    got = {(r.stage, r.key, r.k): r for r in survival.cascade(inflow, steps, ["key"], windows, start).collect()}
    for key, hi in (("x", 40), ("y", 33)):
        enters = feed[key]
        for name in ("one", "two"):
            h = {a: hazards[name][key, a] for a in range(6)}
            begun = initial[name][key]
            if (name, key) == ("one", "y"):  # nobody is 4 or older where the hazard at 3 is 1
                begun = [(min(a, 3), m) for a, m in begun]
            want = walked(h, enters, begun, 10, hi)
            for k, (stock, left, _) in want.items():
                r = got[name, key, k]
                assert (r.stock, r.outflow, r.inflow) == (pytest.approx(stock, abs=1e-9), pytest.approx(left, abs=1e-9), pytest.approx(enters.get(k, 0.0), abs=1e-9)), (name, key, k)
            kept = got[name, key, hi].stock + got[name, key, hi].inflow - got[name, key, hi].outflow
            assert sum(m for _, m in begun) + sum(enters.values()) == pytest.approx(kept + sum(left for _, left, _ in want.values()))  # mass entered = left + stays
            enters = {k: left for k, (_, left, _) in want.items()}
    ages = {(r.k, r.bin): r.n for r in survival.predicted_ages(inflow.where("key = 'x'"), steps["one"].where("key = 'x'"), ["key"], windows.where("key = 'x'"), EDGES).collect()}
    for k, (stock, _, at) in walked({a: hazards["one"]["x", a] for a in range(6)}, feed["x"], [], 10, 40).items():
        for b, inside in ((0, lambda a: a < 1), (1, lambda a: 1 <= a < 3), (2, lambda a: a >= 3)):
            assert ages.get((k, b), 0.0) == pytest.approx(sum(m for a, m in at.items() if inside(a)), abs=1e-9)
        assert sum(n for (j, _), n in ages.items() if j == k) == pytest.approx(stock, abs=1e-9)


def test_attribution_by_request(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        route = rng.randrange(1000)
        ready, admission = route + rng.randrange(40), 0
        admission = ready + rng.randrange(60)
        rows.append((rng.randrange(2), route, ready, admission, admission + rng.randrange(90), rng.randrange(-5, 60), rng.randrange(80)))
    df = spark.createDataFrame(rows, "side int, route_ns long, ready_ns long, admission_ns long, terminal_ns long, handoff_ns long, waiting_ns long")
    counts = {}
    for side, route, ready, admission, end, h, q in rows:
        for world, (hp, qp) in attribution.WORLDS.items():
            a = route + (max(h, 0) if hp else ready - route)
            b = a + (max(q, 0) if qp else admission - ready)
            for stage, lo, hi in (("handoff", route, a), ("waiting", a, b), ("running", b, max(end, b))):
                for k in range(0, 200):
                    if lo <= k * 10 < hi:
                        counts.setdefault((side, stage, k), dict.fromkeys(attribution.WORLDS, 0))[world] += 1
    found = attribution.errors(attribution.worlds(df), ["side"], 10, 1000)
    got = {(r.world, r.stage): r for r in found.collect()}
    for world in attribution.WORLDS:
        for stage in ("handoff", "waiting", "running"):
            pairs = [(c["observed"], c[world]) for (_, s, _), c in counts.items() if s == stage]
            e = (sum((a - p) ** 2 for a, p in pairs) / max(sum(a * a for a, _ in pairs), 1e-30)) ** 0.5
            r = got[world, stage]
            assert (r.n, r.nrmse, r.exact) == (len(pairs), pytest.approx(e), pytest.approx(sum(a == p for a, p in pairs) / len(pairs)))
            assert world != "observed" or (r.nrmse, r.bias, r.exact) == (0.0, 0.0, 1.0)
    side = {r.stage: r for r in attribution.shares(found).collect()}
    assert side["handoff"].waiting == 0.0 and side["handoff"].handoff == side["handoff"].both > 0
    assert df.where(F.lit(False)).count() == attribution.errors(attribution.worlds(df.where("false")), ["side"], 10, 1000).count() == 0
