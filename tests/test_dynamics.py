"""Models of named blocks against the same normal equations in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dynamics


def solved(x, y, penalty, intercept):
    if intercept:
        x = np.column_stack([x, np.ones(len(x))])
    p = penalty * np.eye(x.shape[1])
    if intercept:
        p[-1, -1] = 0
    return np.linalg.solve(x.T @ x + p, x.T @ y)


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(1)
    z, d, u, f = rng.standard_normal((60, 3)), rng.standard_normal((60, 2)), rng.uniform(0.3, 0.7, (60, 1)), rng.standard_normal((60, 2))
    rows = [("ab"[i // 30], i % 30, z[i].tolist(), d[i].tolist(), u[i].tolist(), f[i].tolist(), (z[i] * 2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, k int, z array<double>, d array<double>, u array<double>, f array<double>, y array<double>")
    keep = np.array([i for i in range(60) if i % 30])
    return dynamics.transitions(df, "run", "k", ["z", "d", "f"]), z, d, u, f, keep


@pytest.mark.parametrize("bilinear", [False, True])
def test_dynamic_model(runs, bilinear):
    df, z, d, u, _, i = runs
    y = z[i] * 2
    model = dynamics.fitted(df, dynamics.dynamics("z", "d", "u", bilinear), F.col("y"), 3.0)
    parts = [z[i], z[i] - z[i - 1], d[i], d[i - 1], u[i]] + ([z[i] * u[i]] if bilinear else [])
    want = solved(np.concatenate(parts, axis=1), y, 3.0, True)
    assert np.allclose(np.concatenate([*model.parts.values(), model.constant[None]]), want)
    got = df.select("run", "k", model.column(dynamics.dynamics("z", "d", "u", bilinear)).alias("p")).orderBy("run", "k").collect()
    assert np.allclose([r.p for r in got], np.column_stack([*parts, np.ones(len(i))]) @ want)
    a, change = want[:3].T + (0.5 * want[11:14].T if bilinear else 0), want[3:6].T
    companion = np.block([[a + change, -change], [np.eye(3), np.zeros((3, 3))]])
    assert dynamics.dynamic_radius(model, 0.5) == pytest.approx(np.abs(np.linalg.eigvals(companion)).max())


def test_conservation_and_increments(runs):
    df, z, d, u, f, i = runs
    q = df.withColumn("q", F.slice("z", 2, 2)).withColumn("q_before", F.slice("z_before", 2, 2)).withColumn("common", F.slice("z", 1, 1))
    for level, parts in ((0, [f[i]]), (1, [f[i], f[i - 1], z[i, 1:]]), (2, [f[i], f[i - 1], z[i, 1:], z[i, 1:] * z[i, :1]])):
        blocks = dynamics.conservation("q", "f", "common", level, 1)
        model = dynamics.fitted(q, blocks, F.slice("y", 2, 2), 1.0, intercept=False)
        assert np.allclose(np.concatenate(list(model.parts.values())), solved(np.concatenate(parts, axis=1), z[i, 1:] * 2, 1.0, False))
    m = np.eye(2) + model.parts["q"] + 0.3 * model.parts["q0"]
    assert dynamics.conservation_radius(model, np.array([[0.3]]))[0] == pytest.approx(np.abs(np.linalg.eigvals(m)).max())
    model = dynamics.fitted(q, dynamics.increments("q", "common", "d", "f", "u"), F.slice("y", 2, 2), 1.0)
    x = np.concatenate([z[i, 1:], z[i, 1:] - z[i - 1, 1:], z[i, :1], d[i], d[i - 1], f[i], u[i]], axis=1)
    assert np.allclose(np.concatenate([*model.parts.values(), model.constant[None]]), solved(x, z[i, 1:] * 2, 1.0, True))


def test_radii_equal_simulated_growth():
    rng = np.random.default_rng(2)
    z, dz = rng.standard_normal((2, 2)) * 0.4, rng.standard_normal((2, 2)) * 0.1
    for kind, scales, wide in (("exponential", [2, 5], 2), ("raw_lag", [3], 3), ("multi_scale", [2, 4], 6)):
        memory = rng.standard_normal((wide * 3, 2)) * 0.1  # a signal of three components, the first is the state's second
        model = dynamics.Model({"z": z, "dz": dz, "memory": memory}, np.zeros(2))
        past, held = [rng.standard_normal(2) for _ in range(6)], [rng.standard_normal() for _ in scales] if kind == "exponential" else []
        sizes = []
        for _ in range(600):
            s = lambda lag: np.array([past[lag][1], 0.0, 0.0])
            if kind == "exponential":
                m = np.concatenate([[h, 0.0, 0.0] for h in held])
                held = [np.exp(-1 / t) * h + (1 - np.exp(-1 / t)) * past[0][1] for h, t in zip(held, scales, strict=True)]
            elif kind == "raw_lag":
                m = np.concatenate([s(i) for i in (1, 2, 3)])
            else:
                m = np.concatenate([np.concatenate([sum(s(i) for i in range(n)) / n, sum(s(i) for i in range(n)) * 0.2, s(0) - s(n)]) for n in scales])
            after = past[0] @ z + (past[0] - past[1]) @ dz + m @ memory
            past = [after, *past[:5]]
            size = np.sqrt(sum(float(p @ p) for p in past) + sum(h * h for h in held))
            sizes.append(np.log(size))
            past, held = [p / size for p in past], [h / size for h in held]
        assert np.mean(sizes[300:]) == pytest.approx(np.log(dynamics.memory_radius(model, kind, [1], scales)), abs=0.02), kind


def test_flows_are_bounded_and_delays_recovered(spark, tmp_path):
    rng = np.random.default_rng(3)
    src, inn = rng.uniform(0, 9, (80, 2)), rng.uniform(0, 3, (80, 2))
    tot, tin = src[::-1] + src, inn[::-1] + inn
    y = 0.4 * src + 0.1 * inn - 0.05 * tot + 0.3
    df = spark.createDataFrame([tuple(v.tolist() for v in r) for r in zip(src, inn, tot, tin, y, strict=True)], "a array<double>, b array<double>, c array<double>, d array<double>, y array<double>")
    model = dynamics.flow(df, "a", "b", "c", "d", "y", 0.5)
    x = np.concatenate([src, inn, tot, tin], axis=1)
    want = np.clip((x / x.std(axis=0)) @ solved(x / x.std(axis=0), y / y.std(axis=0), 0.5, False) * y.std(axis=0), 0, np.maximum(src + inn, 0))
    got = df.select(model.column(*(F.col(c) for c in "abcd")).alias("p")).collect()
    assert np.allclose([r.p for r in got], want)
    assert spark.createDataFrame([([0.0, 0.0],) * 4], "a array<double>, b array<double>, c array<double>, d array<double>").select(model.column(*(F.col(c) for c in "abcd"))).first()[0] == [0.0, 0.0]
    f = rng.standard_normal((90, 2))
    seconds = np.expm1(3 + f @ [0.3, -0.2])
    assert seconds.min() > 0
    rows = spark.createDataFrame([(float(s), float(a), float(b), 1.0) for s, (a, b) in zip(seconds, f, strict=True)], "s double, a double, b double, c double")
    kernel = dynamics.delay(rows, F.col("s"), [F.col("a"), F.col("b"), F.col("c")], 1e-9)
    assert rows.select(F.max(F.abs(kernel.column([F.col("a"), F.col("b"), F.col("c")]) - F.col("s")))).first()[0] < 1e-6
    low = spark.createDataFrame([(-40.0, 0.0, 1.0)], "a double, b double, c double")
    assert low.select(kernel.column([F.col("a"), F.col("b"), F.col("c")])).first()[0] == 0.0  # a delay is never negative
    events = dynamics.predicted_events(spark.createDataFrame([(100, 2.0)], "t long, w double"), "t", F.lit(-1.0), lambda _: F.col("w")).first()
    assert (events.kv_ready_predicted, events.admission_predicted) == (100, 2_000_000_100)
    dynamics.written(spark, kernel.model.parts | {"mean": kernel.mean}, str(tmp_path / "m"))
    back = dynamics.read(spark, str(tmp_path / "m"))
    assert np.array_equal(back["x"], kernel.model.parts["x"]) and np.array_equal(back["mean"], kernel.mean)
