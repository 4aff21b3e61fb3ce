"""Representations by numpy, their round trips and files; descriptors by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import representation as rep

NAMES = ["total", "d1_run", "d2_run", "decode-0.w.0", "decode-0.w.1", "decode-1.w.0", "decode-1.w.1", "decode-0.lone", "still"]
MIRRORS = [("d1_", "d2_"), ("decode-0.", "decode-1.")]
BLOCKS = ["s", "s", "s", "w", "w", "w", "w", "w", "s"]


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(6).gamma(2.0, 3.0, (400, 9))
    x[:, 8] = 4.0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "k long, x array<double>")


def test_pairs_follow_names():
    p = rep.paired(NAMES, MIRRORS)
    assert (p.left, p.right, p.rest) == ((1, 3, 4), (2, 5, 6), (0, 7, 8))
    assert rep.families(NAMES, ["w", "run", "none"], MIRRORS) == {"w": ([3, 4], [5, 6]), "run": ([1], [2])}
    with pytest.raises(ValueError):
        rep.paired(["a1", "b1"], [("a", "b"), ("b", "a")])


def test_descriptors_are_sums(spark, data):
    x, df = data
    found = df.where("k < 400").orderBy("k").select(*rep.descriptors("x", {"w": ([3, 4], [5, 6]), "plain": ([0], []), "none": ([], [])})).collect()
    assert np.allclose([tuple(r) for r in found], np.stack([x[:, [3, 4]].sum(1) - x[:, [5, 6]].sum(1), x[:, 0], np.zeros(400)], axis=1))
    assert df.where("k = 400").select(*rep.descriptors("x", {"w": ([3], [5])})).first().w is None


def test_bases_are_those_of_numpy(data):
    x, df = data
    found = rep.fit(df, "x", rep.paired(NAMES, MIRRORS), BLOCKS, (6, 3))
    std = x.std(axis=0)
    z = np.where(std > 1e-9, (x - x.mean(axis=0)) / np.where(std > 1e-9, std, 1), 0)
    weight = np.array([1 / np.sqrt(sum(b == c and s > 1e-9 for c, s in zip(BLOCKS, std, strict=True))) for b in BLOCKS])
    mean, half = (x[:, [1, 3, 4]] + x[:, [2, 5, 6]]) / 2, (x[:, [1, 3, 4]] - x[:, [2, 5, 6]]) / 2
    norm = lambda v: (v - v.mean(axis=0)) / v.std(axis=0)
    common = np.concatenate([(z * weight)[:, [0, 7, 8]], norm(mean)], axis=1)
    assert np.allclose(found.common_energy, np.sort(np.linalg.eigvalsh(common.T @ common / 400))[::-1])
    assert np.allclose(found.difference_energy, np.sort(np.linalg.eigvalsh(norm(half).T @ norm(half) / 400))[::-1])
    assert np.allclose(found.normalised(x)[0], common) and np.allclose(found.normalised(x)[1], norm(half))
    assert np.allclose(np.sum([v for v in found.shares("common", ["s", "w", "s", "m", "m", "m"]).values()], axis=0), 1)
    rank, share, error = found.captured("difference", [1, 3])[0]
    assert (rank, share) == (1, pytest.approx(found.difference_energy[0] / found.difference_energy.sum())) and error == pytest.approx(np.sqrt(1 - share))
    low = rep.fit(df, "x", rep.paired(NAMES, MIRRORS), BLOCKS, (2, 1))
    lost = ((norm(half) - (norm(half) @ low.difference) @ low.difference.T) ** 2).sum() / (norm(half) ** 2).sum()
    assert np.sqrt(lost) == pytest.approx(low.captured("difference", [1])[0][2])


def test_vectors_come_back_and_differences_are_of_pairs(data):
    x, df = data
    found = rep.fit(df, "x", rep.paired(NAMES, MIRRORS), BLOCKS, (6, 3))
    coded = df.orderBy("k").select("k", rep.matrix(found.encode, F.col("x")).alias("z"))
    rows = coded.select("z", rep.matrix(found.decode, F.col("z")).alias("x"), rep.matrix(found.differences, F.col("z")).alias("d")).collect()
    assert rows[-1].z is None and rows[-1].x is None
    assert np.allclose([r.x for r in rows[:-1]], x) and np.allclose([r.d for r in rows[:-1]], x[:, [1, 3, 4]] - x[:, [2, 5, 6]])


def test_what_is_frozen_stays(spark, data, tmp_path):
    _, df = data
    found = rep.fit(df, "x", rep.paired(NAMES, MIRRORS), BLOCKS, (4, 2))
    path = str(tmp_path / "rep")
    digest = rep.frozen(spark, found, path)
    again = rep.thawed(spark, path, digest)
    assert again.digest() == digest and np.array_equal(again.common, found.common) and again.difference.shape == (3, 2)
    with pytest.raises(Exception, match="already exists"):
        rep.frozen(spark, found, path)
    with pytest.raises(ValueError):
        rep.thawed(spark, path, "0" * 64)
    rows = spark.read.parquet(path).withColumn("v", F.when(F.col("name") == "half_std", F.transform("v", lambda v: v + 1e-9)).otherwise(F.col("v")))
    rows.write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="isn't what was frozen"):
        rep.thawed(spark, str(tmp_path / "other"))


def test_pairs_alone_or_none(spark, data):
    x, df = data
    alone = rep.fit(df.select(F.slice("x", 2, 2).alias("x")), "x", rep.paired(NAMES[1:3], MIRRORS), ["s", "s"], (1, 1))
    assert np.allclose(alone.decode(alone.encode(x[:, 1:3])), x[:, 1:3])
    none = rep.fit(df.select(F.slice("x", 1, 2).alias("x")), "x", rep.paired(NAMES[:2], MIRRORS), ["s", "s"], (2, 0))
    assert np.allclose(none.decode(none.encode(x[:, :2])), x[:, :2])
