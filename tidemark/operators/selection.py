"""Scans over candidate models, counterfactual directions, delay kernels, memory and conservation models.

A scan reads the rows twice, once for each split's moments, however many candidates there are: a ridge
model's solution and its squared error on any split follow from that split's second moments alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.linear import Ridge, gram, spectral_radius


@dataclass
class Moments:
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: int


def moments(df: DataFrame, x: str, y: str) -> Moments:
    """Second moments of (1, x) and y."""
    both = df.select(F.concat(F.array(F.lit(1.0)), F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("v"), (F.size(x) + 1).alias("k"))
    first = both.select("k").first()
    if first is None:
        return Moments(np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), 0)
    g, n = gram(both, "v")
    k = first.k
    return Moments(g[:k, :k], g[:k, k:], g[k:, k:], n)


def solved(m: Moments, penalty: float, inputs: int | None = None) -> Ridge:
    """The ridge model on the first ``inputs`` components (all unless given), the intercept not penalised."""
    k = len(m.xx) if inputs is None else inputs + 1
    p = penalty * np.eye(k)
    p[0, 0] = 0.0
    theta = np.zeros((len(m.xx), m.xy.shape[1]))
    theta[:k] = np.linalg.solve(m.xx[:k, :k] + p, m.xy[:k])
    return Ridge(theta)


def error(m: Moments, model: Ridge) -> float:
    """NRMSE over a split, from its moments."""
    t = model.theta
    squares = np.trace(m.yy) - 2 * np.sum(t * m.xy) + np.sum(t * (m.xx @ t))
    return float(np.sqrt(max(0.0, squares) / max(np.trace(m.yy), 1e-30)))


def scan(train: DataFrame, validation: DataFrame, x: str, y: str, penalties: list[float], ranks: list[int]) -> list[dict]:
    """{rank, penalty, train, validation} of each candidate; a rank uses the first so many components."""
    a, b = moments(train, x, y), moments(validation, x, y)
    found = []
    for r in ranks:
        for p in penalties:
            model = solved(a, p, r)
            found.append({"rank": r, "penalty": p, "train": error(a, model), "validation": error(b, model)})
    return found


def parsimonious(candidates: list[dict], tolerance: float) -> dict:
    """Of those within the tolerance of the best: the lowest rank, then the smallest error, then the largest penalty."""
    best = min(c["validation"] for c in candidates)
    return min((c for c in candidates if c["validation"] <= best + tolerance), key=lambda c: (c["rank"], c["validation"], -c["penalty"]))


def predicted(model: Ridge, x: Column, output: int = 0) -> Column:
    """A linear model's output as an expression."""
    weights = F.array(*(F.lit(float(w)) for w in model.theta[1:, output]))
    return F.aggregate(F.zip_with(x.cast("array<double>"), weights, lambda a, b: a * b), F.lit(float(model.theta[0, output])), lambda s, v: s + v)


def direction(df: DataFrame, model: Ridge, x: str, at: int, low: float, high: float, every: int, order: str) -> DataFrame:
    """(n, rising, median): the change of the output when component ``at`` goes from low to high, on every so-manieth row."""
    with_ = lambda v: F.transform(x, lambda e, i: F.when(i == at, F.lit(v)).otherwise(e.cast("double")))
    delta = predicted(model, with_(high)) - predicted(model, with_(low))
    return df.where(F.col(order) % every == 0).select(delta.alias("d")).agg(F.count("*").alias("n"), F.avg((F.col("d") > 0).cast("double")).alias("rising"), F.percentile("d", F.lit(0.5)).alias("median"))


def delay_kernel(df: DataFrame, delay: str, features: list[Column], penalty: float) -> tuple[Ridge, Column]:
    """A ridge model of the logarithm of positive delays, and the delay it predicts as an expression."""
    x = F.array(*(f.cast("double") for f in features))
    rows = df.where(F.col(delay) > 0).select(x.alias("x"), F.array(F.log(F.col(delay).cast("double"))).alias("y"))
    model = solved(moments(rows, "x", "y"), penalty)
    return model, F.exp(predicted(model, x))


def memory_radius(transition: np.ndarray, gain: np.ndarray, taus: list[float]) -> float:
    """Spectral radius of z+ = A z + G m with memories m+ = a m + (1 - a) z, a = exp(-1 / tau)."""
    n = len(transition)
    decay = np.repeat(np.exp(-1.0 / np.asarray(taus)), n)
    feed = np.vstack([np.eye(n)] * len(taus)) * (1 - decay)[:, None]
    return spectral_radius(np.block([[transition, gain], [feed, np.diag(decay)]]))


def odd_symmetry(model: Ridge, samples: int = 1000, seed: int = 0) -> float:
    """Largest difference between the output at -x and minus the output at x, over random inputs."""
    x = np.random.default_rng(seed).standard_normal((samples, len(model.theta) - 1))
    return float(np.abs(model(-x) + model(x)).max())
