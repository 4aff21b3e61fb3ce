"""The test's rows come after the choice, and what was chosen stays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linear, protocol


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((240, 3))
    y = 0.6 * x[:, :1] + 0.2 * x[:, 1:2] + 0.1
    split = ["train", "validation", "test"]
    return spark.createDataFrame([(split[i % 3], a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "split string, x array<double>, y array<double>"), x, y


def test_no_test_without_a_choice(spark, table, tmp_path):
    p = protocol.Protocol(spark, str(tmp_path / "a"), table[0])
    assert p.rows("train", "validation").count() == 160
    for read in (lambda: p.rows("test"), lambda: p.rows("train", "test"), lambda: protocol.tested(p, "x", "y"), p.choice):
        with pytest.raises(protocol.NotFrozen):
            read()
    with pytest.raises(ValueError):
        p.freeze([{"a": 1}], lambda c: {"a": 2})
    assert p.candidates() == []


def test_choice_is_tested_once_and_for_all(spark, table, tmp_path):
    df, x, y = table
    p = protocol.Protocol(spark, str(tmp_path / "b"), df)
    chosen = protocol.scanned(p, "x", "y", [1e-6, 50.0], [1, 2, 3], 1e-3, state=True)
    assert (chosen["rank"], chosen["penalty"]) == (2, 1e-6) and chosen["radius"] == pytest.approx(0.6, abs=1e-6)
    assert p.rows("test").count() == 80 and len(p.candidates()) == 6
    found = protocol.tested(protocol.Protocol(spark, p.path, df), "x", "y")
    learned = np.arange(240) % 3 != 2
    mean = y[learned].mean()
    assert found["test"] < 1e-6 and found["skill"] == pytest.approx(1 - found["test"] / np.sqrt(((y[~learned] - mean) ** 2).sum() / (y[~learned] ** 2).sum()))
    with pytest.raises(protocol.Frozen):
        protocol.scanned(p, "x", "y", [1.0], [1], 0.1)
    with pytest.raises(protocol.Frozen):
        p.freeze([{"a": 1}], lambda c: c[0])


def test_changed_candidates_close_the_test(spark, table, tmp_path):
    p = protocol.Protocol(spark, str(tmp_path / "c"), table[0])
    p.freeze([{"rank": 1, "validation": 0.5}, {"rank": 2, "validation": 0.4}], lambda c: c[1])
    rows = spark.read.parquet(f"{p.path}/choice").withColumn("row", F.regexp_replace("row", "0.5", "0.3"))
    rows.write.parquet(str(tmp_path / "d" / "choice"))
    with pytest.raises(protocol.NotFrozen, match="changed"):
        protocol.Protocol(spark, str(tmp_path / "d"), table[0]).rows("test")


def test_split_filter_reaches_the_scan(spark, table, tmp_path):
    table[0].write.parquet(str(tmp_path / "rows"))
    plan = protocol.Protocol(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "rows"))).rows("train").select("x")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(split), EqualTo(split,train)]" in text


def test_stable_ones_and_richer_families():
    of = lambda rank, v, r: {"rank": rank, "penalty": 1.0, "validation": v, "radius": r}
    assert protocol.stable([of(1, 0.1, 1.2), of(2, 0.2, 0.9), of(3, 0.2005, 0.5)], 0.01) == of(2, 0.2, 0.9)
    with pytest.raises(ValueError):
        protocol.stable([of(1, 0.1, 1.2)], 0.01)
    plain = of(1, 0.2, 0.9)
    assert protocol.retained(plain, of(1, 0.18, 0.91), 0.05, 0.02) and not protocol.retained(plain, of(1, 0.18, 0.95), 0.05, 0.02)
    assert not protocol.retained(plain, of(1, 0.195, 0.9), 0.05, 0.02) and not protocol.retained(plain, None, 0.05, 0.02)


def test_slow_rows_are_means_and_sums_of_full_blocks(spark):
    df = spark.createDataFrame([(r, k, float(k), float(r)) for r in (1, 2) for k in range(11)], "run int, k int, a double, b double")
    found = sorted(protocol.slow_rows(df, ["run"], "k", 5, ["a"], ["b"]).collect())
    assert [(r.run, r.block, r.x, r.y) for r in found] == [(1, 0, [2.0], [5.0]), (1, 1, [7.0], [5.0]), (2, 0, [2.0], [10.0]), (2, 1, [7.0], [10.0])]
    assert linear.spectral_radius(np.zeros((0, 0))) == 0.0
