"""Linear models made of named blocks of features: dynamics with lags and control, memories, increments, conservation, flows, delays.

A block is an array column; a model's design is the concatenation of its blocks, and its solution comes from the design's
second moments, one aggregation however many rows there are. Rows of a run are joined to the row before by a window, so no
block looks over a run's start. Stability is read off the map that takes one unit of augmented state a step further.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.linear import gram


def plus(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def transitions(df: DataFrame, run: str, order: str, columns: list[str]) -> DataFrame:
    """df with the same columns of the row before (name_before), without each run's first row."""
    w = W.partitionBy(run).orderBy(order)
    return df.select("*", *(F.lag(c).over(w).alias(f"{c}_before") for c in columns), F.row_number().over(w).alias("_i")).where("_i > 1").drop("_i")


@dataclass
class Model:
    """Coefficients by block, each (width, outputs), and the intercept if there is one."""

    parts: dict[str, np.ndarray]
    constant: np.ndarray

    def __call__(self, **blocks: np.ndarray) -> np.ndarray:
        return self.constant + sum(np.asarray(blocks[k], float) @ v for k, v in self.parts.items())

    def column(self, blocks: dict[str, Column]) -> Column:
        """The prediction as an array expression."""
        outputs = []
        for j in range(len(self.constant)):
            total = F.lit(float(self.constant[j]))
            for k, v in self.parts.items():
                weights = F.array(*(F.lit(float(w)) for w in v[:, j]))
                total = total + F.aggregate(F.zip_with(blocks[k], weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            outputs.append(total)
        return F.array(*outputs)


def fitted(df: DataFrame, blocks: dict[str, Column], target: Column, penalty: float, intercept: bool = True) -> Model:
    """Ridge regression of an array on the blocks; the intercept isn't penalised."""
    arrays = {k: c.cast("array<double>") for k, c in blocks.items()}
    ones = F.array(F.lit(1.0)) if intercept else F.array().cast("array<double>")
    rows = df.select(F.concat(*arrays.values(), ones).alias("x"), target.cast("array<double>").alias("y"), *(F.size(c).alias(f"_n{i}") for i, c in enumerate(arrays.values())))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to learn from")
    widths = [first[f"_n{i}"] for i in range(len(arrays))]
    g, _ = gram(rows, "x")
    h, _ = gram(rows, "x", "y")
    p = penalty * np.eye(len(g))
    if intercept:
        p[-1, -1] = 0.0
    theta = np.linalg.solve(g + p, h)
    ends = np.cumsum(widths)
    parts = {k: theta[e - n : e] for k, n, e in zip(arrays, widths, ends, strict=True)}
    return Model(parts, theta[-1] if intercept else np.zeros(theta.shape[1]))


def dynamics(z: str, d: str, u: str, bilinear: bool = False) -> dict[str, Column]:
    """Blocks of z+ by state, its change, disturbances now and before, control, and state times control; over transitions()."""
    found = {"z": F.col(z), "dz": minus(F.col(z), F.col(f"{z}_before")), "d": F.col(d), "d_before": F.col(f"{d}_before"), "u": F.col(u)}
    return found | ({"zu": times(F.col(z), F.col(u)[0])} if bilinear else {})


def increments(q: str, common: str, d: str, forcing: str | None, u: str | None) -> dict[str, Column]:
    """Blocks of the change of q: itself, its change, what both sides share, disturbances now and before, and forcing, command or both."""
    found = {"q": F.col(q), "dq": minus(F.col(q), F.col(f"{q}_before")), "common": F.col(common), "d": F.col(d), "d_before": F.col(f"{d}_before")}
    return found | ({"forcing": F.col(forcing)} if forcing else {}) | ({"u": F.col(u)} if u else {})


def conservation(q: str, forcing: str, common: str | None = None, level: int = 0, width: int = 0) -> dict[str, Column]:
    """Blocks without an intercept, odd in q and forcing: 0 inflow alone; 1 with the inflow before and q; 2 with q times each of ``width`` loads in ``common``."""
    found = {"forcing": F.col(forcing)}
    if level:
        found |= {"forcing_before": F.col(f"{forcing}_before"), "q": F.col(q)}
    return found | ({f"q{i}": times(F.col(q), F.col(common)[i]) for i in range(width)} if level == 2 else {})


def radius(step: Callable[[np.ndarray], np.ndarray], size: int) -> float:
    """Spectral radius of a linear map of vectors of that size."""
    matrix = np.stack([np.asarray(step(e), float) for e in np.eye(size)], axis=1)
    return float(np.abs(np.linalg.eigvals(matrix)).max()) if size else 0.0


def dynamic_radius(model: Model, u: float = 0.0) -> float:
    """Of z+ with the state before as part of the state, at a nominal control."""
    n = len(model.parts["z"])

    def step(x: np.ndarray) -> np.ndarray:
        z, before = x[:n], x[n:]
        after = z @ model.parts["z"] + (z - before) @ model.parts["dz"]
        if "zu" in model.parts:
            after = after + u * z @ model.parts["zu"]
        return np.concatenate([after, z])

    return radius(step, 2 * n)


def memory_radius(model: Model, kind: str, signal: list[int], scales: list[int], dt: float = 0.2) -> float:
    """Of a model with block ``memory`` over the signal's components (of which the first are the state's at ``signal``).

    kind: exponential (a memory for each scale, before its update), raw_lag (the signal 1 to scales[0] rows before), multi_scale (mean, integral and change over each scale).
    """
    n, k = len(model.parts["z"]), len(signal)
    weights = model.parts["memory"]
    wide = len(weights) // (len(scales) if kind == "exponential" else scales[0] if kind == "raw_lag" else 3 * len(scales))
    part = lambda i: weights[i * wide : i * wide + k]  # noqa: E731  the state's share of the i-th memory of the signal
    depth = max(2, max(scales) + 1)

    def step(x: np.ndarray) -> np.ndarray:
        if kind == "exponential":
            z, before, held = x[:n], x[n : 2 * n], x[2 * n :].reshape(len(scales), k)
            after = z @ model.parts["z"] + (z - before) @ model.parts["dz"] + sum(held[i] @ part(i) for i in range(len(scales)))
            decay = np.exp(-1.0 / np.asarray(scales, float))[:, None]
            return np.concatenate([after, z, (decay * held + (1 - decay) * z[signal]).ravel()])
        past = x.reshape(depth, n)
        after = past[0] @ model.parts["z"] + (past[0] - past[1]) @ model.parts["dz"]
        if kind == "raw_lag":
            after = after + sum(past[i][signal] @ part(i - 1) for i in range(1, scales[0] + 1))
        else:
            for i, s in enumerate(scales):
                total = past[:s, signal].sum(axis=0)
                after = after + (total / s) @ part(3 * i) + (total * dt) @ part(3 * i + 1) + (past[0][signal] - past[s][signal]) @ part(3 * i + 2)
        return np.concatenate([after, past[:-1].ravel()])

    return radius(step, 2 * n + len(scales) * k if kind == "exponential" else depth * n)


def increment_radius(whole: Model, model: Model, common: int) -> float:
    """Of a dynamic model whose last components' change is given by an increment model of them and the first ``common`` ones."""
    n, k = len(whole.parts["z"]), len(model.parts["q"])

    def step(x: np.ndarray) -> np.ndarray:
        z, before = x[:n], x[n:]
        after = z @ whole.parts["z"] + (z - before) @ whole.parts["dz"]
        q, q_before = z[n - k :], before[n - k :]
        moved = q + q @ model.parts["q"] + (q - q_before) @ model.parts["dq"] + z[:common] @ model.parts["common"]
        return np.concatenate([after[: n - k], moved, z])

    return radius(step, 2 * n)


def conservation_radius(model: Model, loads: np.ndarray) -> tuple[float, float]:
    """Largest spectral radius of q + change over rows of loads, and its 95th percentile."""
    q = model.parts.get("q")
    if q is None:
        return 1.0, 1.0
    found = []
    for row in np.atleast_2d(loads):
        m = np.eye(len(q)) + q + sum((row[i] * model.parts[f"q{i}"] for i in range(len(row)) if f"q{i}" in model.parts), np.zeros_like(q))
        found.append(np.abs(np.linalg.eigvals(m)).max())
    return float(np.max(found)), float(np.quantile(found, 0.95))


def scales_of(df: DataFrame, column: str) -> np.ndarray:
    """Population deviation of each component of an array column; 1 where it doesn't vary."""
    rows = df.select(F.posexplode(F.col(column).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("s")).orderBy("i").collect()
    s = np.array([r.s for r in rows], float)
    return np.where(s < 1e-12, 1.0, s)


@dataclass
class Flow:
    """A flow between stages, from what its source has and gets, on this side and on both."""

    model: Model
    inputs: np.ndarray
    outputs: np.ndarray

    def column(self, source: Column, inflow: Column, all_source: Column, all_inflow: Column) -> Column:
        """Never negative, never more than the source has and gets."""
        x = F.concat(source, inflow, all_source, all_inflow)
        scaled = F.zip_with(x, F.array(*(F.lit(float(s)) for s in self.inputs)), lambda a, b: a / b)
        raw = F.zip_with(self.model.column({"x": scaled}), F.array(*(F.lit(float(s)) for s in self.outputs)), lambda a, b: a * b)
        most = F.transform(plus(source, inflow), lambda v: F.greatest(v, F.lit(0.0)))
        return F.zip_with(raw, most, lambda a, b: F.least(F.greatest(a, F.lit(0.0)), b))


def flow(df: DataFrame, source: str, inflow: str, all_source: str, all_inflow: str, target: str, penalty: float) -> Flow:
    """One model for both sides: rows (source, inflow, all_source, all_inflow, target: arrays of quantities) of each side and window; scaled, without an intercept."""
    rows = df.select(F.concat(*(F.col(c).cast("array<double>") for c in (source, inflow, all_source, all_inflow))).alias("x"), F.col(target).cast("array<double>").alias("y"))
    sx, sy = scales_of(rows, "x"), scales_of(rows, "y")
    over = lambda c, s: F.zip_with(F.col(c), F.array(*(F.lit(float(v)) for v in s)), lambda a, b: a / b)
    return Flow(fitted(rows, {"x": over("x", sx)}, over("y", sy), penalty, intercept=False), sx, sy)


@dataclass
class Delay:
    """log1p of a delay in seconds by standardised features."""

    model: Model
    mean: np.ndarray
    scale: np.ndarray

    def column(self, features: list[Column]) -> Column:
        x = F.array(*((f.cast("double") - float(m)) / float(s) for f, m, s in zip(features, self.mean, self.scale, strict=True)))
        return F.greatest(F.expm1(self.model.column({"x": x})[0]), F.lit(0.0))


def delay(df: DataFrame, seconds: Column, features: list[Column], penalty: float) -> Delay:
    """The kernel of one stage; sums of kernels' columns are the decomposed kernel."""
    names = [f"_f{i}" for i in range(len(features))]
    rows = df.select(seconds.cast("double").alias("_d"), *(f.cast("double").alias(n) for f, n in zip(features, names, strict=True)))
    found = rows.agg(*(F.avg(n).alias(f"m{n}") for n in names), *(F.stddev_pop(n).alias(f"s{n}") for n in names)).first()
    mean, scale = np.array([found[f"m{n}"] for n in names], float), np.array([found[f"s{n}"] for n in names], float)
    scale = np.where(scale < 1e-12, 1.0, scale)
    x = F.array(*((F.col(n) - float(m)) / float(s) for n, m, s in zip(names, mean, scale, strict=True)))
    return Delay(fitted(rows, {"x": x}, F.array(F.log1p("_d")), penalty), mean, scale)


def predicted_events(df: DataFrame, route: str, handoff: Column, waiting: Callable[[str], Column]) -> DataFrame:
    """df with kv_ready_predicted and admission_predicted: never before what they follow; delays in seconds, the second may look at the predicted first."""
    ns = lambda s: (s * 1e9).cast("long")
    first = df.withColumn("kv_ready_predicted", F.greatest(F.col(route), F.col(route) + ns(handoff)))
    return first.withColumn("admission_predicted", F.greatest(F.col("kv_ready_predicted"), F.col("kv_ready_predicted") + ns(waiting("kv_ready_predicted"))))


def written(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Arrays by name as a small table, on any file system."""
    rows = [(k, [int(n) for n in np.shape(v)], np.ravel(np.asarray(v, float)).tolist()) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r.v, float).reshape(r.shape) for r in spark.read.parquet(path).collect()}
