"""Free rollouts against walks row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dynamics, rollouts


def runs(spark, rng, n, **widths):
    """Two runs of rows with random inputs, and the inputs by run."""
    rows, of = [], {}
    for run, length in (("a", n), ("b", n // 2)):
        of[run] = {k: rng.standard_normal((length, w)) for k, w in widths.items()}
        rows += [(run, i, *(of[run][k][i].tolist() for k in widths)) for i in range(length)]
    return spark.createDataFrame(rows, "run string, k int, " + ", ".join(f"{k} array<double>" for k in widths)).repartition(7), of


def check(found, want):
    got = {}
    for r in found.collect():
        got.setdefault(r.run, {})[r.k] = r.predicted
    for run, rows in want.items():
        assert sorted(got[run]) == list(range(len(rows)))
        for k, row in enumerate(rows):
            assert (got[run][k] is None) == (row is None), (run, k)
            assert row is None or np.allclose(got[run][k], row, rtol=1e-9, atol=1e-9), (run, k)


@pytest.mark.parametrize("bilinear", [False, True])
def test_lag_and_control(spark, bilinear):
    rng = np.random.default_rng(1)
    w = lambda *s: rng.standard_normal(s) * 0.2
    model = dynamics.Model({"z": w(3, 3) + 0.5 * np.eye(3), "dz": w(3, 3), "d": w(2, 3), "d_before": w(2, 3), "u": w(1, 3)} | ({"zu": w(3, 3)} if bilinear else {}), w(3))
    df, of = runs(spark, rng, 60, d=2, d_before=2, u=1, start=6)
    want = {}
    for run, x in of.items():
        z, before = x["start"][0][:3], x["start"][0][3:]
        want[run] = []
        for k in range(len(x["u"])):
            want[run].append(z)
            blocks = {"z": z, "dz": z - before, "d": x["d"][k], "d_before": x["d_before"][k], "u": x["u"][k]}
            z, before = model(**blocks | ({"zu": z * x["u"][k][0]} if bilinear else {})), z
    columns = {c: F.col(c) for c in ("d", "d_before", "u")} | ({"gain": F.col("u")} if bilinear else {})
    for block in (7, 1024):
        check(rollouts.free(df, "run", "k", rollouts.lagged(model), columns, F.col("start"), block=block), want)


def test_memories(spark):
    rng = np.random.default_rng(2)
    z, dz = rng.standard_normal((2, 2)) * 0.3, rng.standard_normal((2, 2)) * 0.1
    for kind, scales, wide in (("exponential", [2, 5], 2), ("raw_lag", [3], 3), ("multi_scale", [2, 4], 6)):
        weights = rng.standard_normal((wide * 3, 2)) * 0.1  # a signal of three components: the state's second, and two of its own
        model = dynamics.Model({"z": z, "dz": dz, "memory": weights}, rng.standard_normal(2) * 0.1)
        df, of = runs(spark, rng, 40, memory=wide * 3)
        zero = F.transform("memory", lambda x, i: F.when(i % 3 == 0, 0.0).otherwise(x))  # the state's places
        walk = rollouts.remembering(model, kind, [1], scales)
        want = {}
        for run, x in of.items():
            past, held, want[run] = [np.array([0.4, -0.2])] + [np.zeros(2)] * 6, [0.0] * len(scales), []
            for k in range(len(x["memory"])):
                want[run].append(past[0])
                m = x["memory"][k].copy()
                s = lambda lag: past[lag][1]
                if kind == "exponential":
                    m[::3] = held
                    held = [np.exp(-1 / t) * h + (1 - np.exp(-1 / t)) * s(0) for h, t in zip(held, scales, strict=True)]
                elif kind == "raw_lag":
                    m[::3] = [s(1), s(2), s(3)]
                else:
                    m[::3] = [v for n in scales for v in (sum(s(i) for i in range(n)) / n, sum(s(i) for i in range(n)) * 0.2, s(0) - s(n))]
                past = [model(z=past[0], dz=past[0] - past[1], memory=m), *past[:6]]
        start = F.array(*(F.lit(v) for v in [0.4, -0.2] + [0.0] * (len(walk.constant) - 2)))
        check(rollouts.free(df, "run", "k", walk, {"memory": zero}, start, block=6), want)
        assert np.abs(np.linalg.eigvals(walk.base)).max() == pytest.approx(dynamics.memory_radius(model, kind, [1], scales))


def test_forcing_and_conservation(spark):
    rng = np.random.default_rng(3)
    w = lambda *s: rng.standard_normal(s) * 0.1
    forced = dynamics.Model({"q": w(2, 2) - 0.2 * np.eye(2), "dq": w(2, 2), "common": w(3, 2), "d": w(1, 2), "d_before": w(1, 2), "forcing": w(2, 2), "u": w(1, 2)}, w(2))
    df, of = runs(spark, rng, 50, common=3, d=1, d_before=1, forcing=2, u=1, forcing_before=2, loads=2, start=4)
    want, kept = {}, {}
    level = dynamics.Model({"forcing": w(2, 2), "forcing_before": w(2, 2), "q": w(2, 2), "q0": w(2, 2), "q1": w(2, 2)}, np.zeros(2))
    for run, x in of.items():
        q, before, c = x["start"][0][:2], x["start"][0][2:], x["start"][0][:2]
        want[run], kept[run] = [], []
        for k in range(len(x["u"])):
            want[run].append(q)
            kept[run].append(c)
            q, before = q + forced(q=q, dq=q - before, **{n: x[n][k] for n in ("common", "d", "d_before", "forcing", "u")}), q
            c = c + level(forcing=x["forcing"][k], forcing_before=x["forcing_before"][k], q=c, q0=c * x["loads"][k][0], q1=c * x["loads"][k][1])
    names = ("common", "d", "d_before", "forcing", "u")
    check(rollouts.free(df, "run", "k", rollouts.incremental(forced), {n: F.col(n) for n in names}, F.col("start"), block=9), want)
    check(rollouts.free(df, "run", "k", rollouts.conserving(level), {n: F.col(n) for n in ("forcing", "forcing_before", "loads")}, F.slice("start", 1, 2), block=9), kept)


def test_a_run_ends_at_the_bound(spark):
    rng = np.random.default_rng(4)
    model = dynamics.Model({"z": np.array([[1.6]]), "dz": np.zeros((1, 1)), "u": np.ones((1, 1))}, np.zeros(1))
    df, of = runs(spark, rng, 2000, u=1)
    want = {}
    for run, x in of.items():
        z, want[run] = 1.0, []
        for k in range(len(x["u"])):
            want[run].append(None if want[run] and want[run][-1] is None or not abs(z) <= 1e6 else [z])
            z = 1.6 * z + x["u"][k][0] if np.isfinite(z) and abs(z) < 1e9 else z
    found = rollouts.free(df, "run", "k", rollouts.lagged(model), {"u": F.col("u")}, F.array(F.lit(1.0), F.lit(1.0)), block=5)
    check(found, want)
    rows = df.select("run", "k", F.array(F.lit(2.0)).alias("a"), F.array(F.lit(1.0)).alias("h")).join(found, ["run", "k"])
    r = {x.run: x for x in rollouts.evaluated(rows, ["run"], "a", "predicted", "h").collect()}["a"]
    good = np.array([x[0] for x in want["a"] if x])
    assert (r.n, r.ended, r.output) == (len(good), 2000 - len(good), 0) and r.nrmse == pytest.approx(np.sqrt(((good - 2) ** 2).sum() / (4 * len(good))))
    assert r.persistence == pytest.approx(0.5) and r.skill == pytest.approx(1 - r.nrmse / 0.5)


def test_clipped_flows(spark):
    rng = np.random.default_rng(5)
    flows = [dynamics.Flow(dynamics.Model({"x": rng.standard_normal((8, 2)) * 0.6}, np.zeros(2)), rng.uniform(1, 3, 8), rng.uniform(1, 3, 2)) for _ in range(3)]
    rows, of = [], {}
    for run, n in (("a", 300), ("b", 40)):
        of[run] = (rng.uniform(0, 5, (n, 2, 2)), rng.uniform(0, 9, (3, 2, 2)))
        rows += [(run, k, of[run][0][k].ravel().tolist(), of[run][1].ravel().tolist()) for k in range(n)]
    df = spark.createDataFrame(rows, "run string, k int, inflow array<double>, start array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # stocks are handed on
    try:
        got = {(r.run, r.k): r for r in rollouts.flow_rollout(df, "run", "k", "inflow", "start", flows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run, (feed, start) in of.items():
        stocks, left = start.copy(), np.zeros(4)
        for k in range(len(feed)):
            r = got[run, k]
            assert np.allclose(np.reshape(r.stocks, (3, 2, 2)), stocks) and np.min(r.stocks) >= 0
            inflow, after = feed[k], stocks.copy()
            for i, f in enumerate(flows):
                for side in (0, 1):
                    x = np.concatenate([stocks[i][side], inflow[side], stocks[i].sum(axis=0), inflow.sum(axis=0)])
                    most = np.maximum(stocks[i][side] + inflow[side], 0)
                    after[i][side] = stocks[i][side] + inflow[side] - np.clip((x / f.inputs) @ f.model.parts["x"] * f.outputs, 0, most)
                inflow = stocks[i] + inflow - after[i]
            stocks = after
            left = left + inflow.ravel()
        total = start.sum(axis=0).ravel() + feed.sum(axis=0).ravel()
        assert np.allclose(total, left + stocks.sum(axis=0).ravel())  # nothing is lost or made
