"""Candidate scans from moments, delay kernels and control rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import control, linear, selection


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 4))
    y = x[:, :2] @ [[2.0], [-1.0]] + 0.3
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y array<double>"), x, y


def test_errors_follow_from_moments(rows):
    df, x, y = rows
    m = selection.moments(df, "x", "y")
    for penalty, rank in ((1.0, 4), (50.0, 2), (1e-9, 1)):
        model = selection.solved(m, penalty, rank)
        assert selection.error(m, model) == pytest.approx(np.sqrt(((y - model(x)) ** 2).sum() / (y**2).sum()), abs=1e-7)
    assert np.allclose(selection.solved(m, 3.0).theta, linear.ridge(df, "x", "y", 3.0).theta)


def test_scan_prefers_the_lower_rank(rows):
    df, _, _ = rows
    found = selection.scan(df.where("k < 200"), df.where("k >= 200"), "x", "y", [1e-6, 1.0], [1, 2, 4])
    best = selection.parsimonious(found, 0.005)
    assert (best["rank"], best["penalty"]) == (2, 1e-6) and len(found) == 6


def test_direction_and_delay(rows):
    df, _, _ = rows
    model = selection.solved(selection.moments(df, "x", "y"), 1e-9)
    got = selection.direction(df, model, "x", 1, 0.4, 0.6, 20, "k").first()
    assert (got.n, got.rising) == (15, 0.0) and got.median == pytest.approx(-0.2)
    delays = df.select("k", (F.exp(0.5 + 0.25 * (F.col("k") % 7)) * 1.0).alias("d"))
    _, expression = selection.delay_kernel(delays, "d", [F.col("k") % 7], 1e-9)
    assert delays.select(F.max(F.abs(expression - F.col("d")))).first()[0] < 1e-6
    assert selection.odd_symmetry(linear.Ridge(np.array([[0.0], [2.0]]))) == 0 and selection.odd_symmetry(linear.Ridge(np.array([[1.0], [2.0]]))) == pytest.approx(2)
    assert selection.memory_radius(np.array([[0.5]]), np.array([[0.0]]), [2.0]) == pytest.approx(np.exp(-0.5))


def test_control_rules(spark):
    applied = spark.createDataFrame([("r", "c1", 5, 0.3), ("r", "c1", 5, 0.3), ("r", "c2", 9, 0.5), ("r", "c2", 9, 0.7)], "run_id string, command_id string, applied_ns long, u double")
    one, bad = control.commands(applied)
    assert one.count() == 2 and [r.key for r in bad.collect()] == ["c2"]
    windows = spark.createDataFrame([("r", k, 10 * k, u, a) for k, (u, a) in enumerate([(0.3, 0), (0.3, 0), (0.5, 25), (0.7, 30), (0.7, None)])], "run_id string, window_id long, start_ns long, u double, applied_ns long")
    assert [r.detail for r in control.missing_levels(windows, [0.3, 0.5, 0.7, 0.9]).collect()] == ["0.9"]
    assert sorted(r.code for r in control.early_effects(windows).collect()) == ["effect_before_command", "window_before_first_command"]
    assert [r.key for r in control.short_dwells(windows, 2).collect()] == ["2"]
    emissions = spark.createDataFrame([("r", "a", "d0"), ("r", "a", "d1"), ("r", "b", "d0")], "run_id string, request_id string, component string")
    assert [r.key for r in control.migrations(emissions).collect()] == ["a"]
