"""Normalisation, second moments, orthogonal decomposition, ridge models and rollouts.

Vectors are array columns. Anything that depends on the number of rows is an aggregation; what reaches the
driver is a matrix of the vectors' width, where eigenvectors and solutions are found.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Units whose quantities are taken as log1p.
LOG_UNITS = ("requests", "tokens", "bytes", "blocks", "ms")


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it (unless it was shipped to them)."""
    root, path = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = f"{path}{os.pathsep}{root}".strip(os.pathsep)


def long_form(df: DataFrame, vector: str, keys: list[str] = ()) -> DataFrame:
    """(keys, dim, v) of each component."""
    return df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))


def feature_stats(df: DataFrame, vector: str, log: bool = False) -> DataFrame:
    """(dim, n, mean, std, nonzero, lo, hi) of each component (after log1p); population deviation."""
    v = F.log1p("v") if log else F.col("v")
    return long_form(df, vector).withColumn("v", v).groupBy("dim").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count_if(F.col("v") != 0).alias("nonzero"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def active(mean: Column, std: Column) -> Column:
    """Whether a component varies."""
    return std > F.greatest(F.lit(1e-12), F.abs(mean) * 1e-10)


def block_normalizer(stats: DataFrame, index: DataFrame) -> DataFrame:
    """(dim, mean, std, active, weight): a block's weight is one over the root of its active components. index: (dim, block)."""
    s = stats.join(index, "dim").withColumn("active", active(F.col("mean"), F.col("std")))
    width = F.count_if("active").over(W.partitionBy("block"))
    return s.withColumn("weight", F.when(F.col("active"), 1 / F.sqrt(width.cast("double"))).otherwise(0.0))


def normalized(rows: DataFrame, normalizer: DataFrame, keys: list[str], weighted: bool = True) -> DataFrame:
    """(keys, dim, z) of long-form rows; components that don't vary are 0. The normalizer has one row for each component."""
    z = F.when(F.col("active"), (F.col("v") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return rows.join(normalizer.select("dim", "mean", "std", "active", "weight"), "dim").select(*keys, "dim", (z * F.col("weight") if weighted else z).alias("z"))


def gram(df: DataFrame, x: str, y: str | None = None) -> tuple[np.ndarray, int]:
    """Sum over rows of x y' (y = x unless given), and the number of rows: partial sums by task, added up by Spark."""
    importable(df.sparkSession)
    y = y or x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            a, c = (np.asarray(b.column(k).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1) for k in (0, 1))
            if b.num_rows:
                total, n = (a.T @ c if total is None else total + a.T @ c), n + b.num_rows
        if n:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel()), pa.array(np.full(total.size, n))], names=["i", "j", "s", "n"])

    parts = df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).mapInArrow(run, "i long, j long, s double, n long")
    t = parts.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    if not t.num_rows:
        return np.zeros((0, 0)), 0
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    out = np.zeros((i.max() + 1, j.max() + 1))
    out[i, j] = t["s"].to_numpy()
    return out, int(t["n"][0].as_py())


@dataclass
class Decomposition:
    basis: np.ndarray  # (dims, rank)
    eigenvalues: np.ndarray  # all, falling


def pod(df: DataFrame, vector: str, rank: int) -> Decomposition:
    """Eigenvectors of the second moment of already normalised vectors, not centred; signs are arbitrary."""
    g, n = gram(df, vector)
    values, vectors = np.linalg.eigh(g / max(n, 1))
    order = np.argsort(-values, kind="stable")
    return Decomposition(vectors[:, order[:rank]], np.maximum(values[order], 0))


def projected(df: DataFrame, vector: str, basis: np.ndarray, name: str = "z") -> DataFrame:
    """df with the vector's coordinates in a basis, by expressions: no Python on the executors."""
    dot = lambda b: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, map(float, b))), lambda p, q: p * q), F.lit(0.0), lambda s, q: s + q)
    return df.withColumn(name, F.array(*(dot(basis[:, k]) for k in range(basis.shape[1]))))


def captured(d: Decomposition, ranks: list[int]) -> list[tuple[int, float, float]]:
    """(rank, share of energy, reconstruction error) from the eigenvalues alone."""
    total = d.eigenvalues.sum() or 1.0
    return [(r, float(d.eigenvalues[:r].sum() / total), float(np.sqrt(max(0.0, 1 - d.eigenvalues[:r].sum() / total)))) for r in ranks]


@dataclass
class Ridge:
    theta: np.ndarray  # (1 + inputs, outputs), the first row is the intercept

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.theta[0] + x @ self.theta[1:]


def ridge(df: DataFrame, x: str, y: str, penalty: float, intercept: bool = True) -> Ridge:
    """Least squares with ``penalty`` times the squared norm (not scaled by rows); the intercept isn't penalised."""
    both = F.concat(F.array(F.lit(1.0 if intercept else 0.0)), F.col(x).cast("array<double>"))
    rows = df.select(both.alias("x"), F.col(y).cast("array<double>").alias("y"))
    g, _ = gram(rows, "x")
    h, _ = gram(rows, "x", "y")
    p = penalty * np.eye(len(g))
    p[0, 0] = 0.0 if intercept else 1.0
    return Ridge(np.linalg.solve(g + p, h))


def spectral_radius(transition: np.ndarray, previous: np.ndarray | None = None) -> float:
    """Of z+ = A z + B z-1, by its companion matrix."""
    n = len(transition)
    m = transition if previous is None else np.block([[transition, previous], [np.eye(n), np.zeros((n, n))]])
    return float(np.abs(np.linalg.eigvals(m)).max()) if n else 0.0


def rollout(df: DataFrame, run: str, order: str, state: str, inputs: str | None, model: Ridge, bound: float = 1e6) -> DataFrame:
    """(run, order, predicted) of a free run of z+ = model(z, inputs) from each run's first state.

    Sequential within a run, parallel over runs; ends at a state beyond ``bound``, from where predictions are null.
    """
    importable(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theta = model.theta

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        z = np.array(t[state].to_pylist(), float)
        d = np.array(t[inputs].to_pylist(), float) if inputs else np.zeros((len(z), 0))
        out: list[list[float] | None] = [list(z[0])]
        at = z[0]
        for k in range(len(z) - 1):
            at = theta[0] + np.concatenate([at, d[k]]) @ theta[1:]
            if not np.isfinite(at).all() or np.abs(at).max() > bound:
                out += [None] * (len(z) - 1 - k)
                break
            out.append(list(at))
        return pa.table({run: t[run], order: t[order], "predicted": pa.array(out, pa.list_(pa.float64()))})

    columns = [run, order, state, *([inputs] if inputs else [])]
    return df.select(*columns).groupBy(run).applyInArrow(one, f"{run} {kinds[run]}, {order} {kinds[order]}, predicted array<double>")


def symmetric_ridge(df: DataFrame, x: str, y: str, penalty: float) -> Ridge:
    """A model without intercept: odd in its inputs, so mirrored inputs give mirrored outputs."""
    return ridge(df, x, y, penalty, intercept=False)


def bounded_flow(model: Ridge, source: Column, features: list[Column]) -> Column:
    """A predicted flow that is neither negative nor more than its source has."""
    raw = F.lit(float(model.theta[0, 0]))
    for f, w in zip(features, model.theta[1:, 0], strict=True):
        raw = raw + f * float(w)
    return F.least(F.greatest(raw, F.lit(0.0)), source)
