"""Frozen representations of vectors: mirrored components as means and half differences, normalised, on orthogonal bases.

A representation is fitted from aggregations whose results are as wide as a vector, written once with a digest, and
read back unchanged; encoding and decoding are matrix products of Arrow batches. Descriptors are sparse sums of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import linear


@dataclass(frozen=True)
class Pairs:
    """Positions of mirrored components, left and right in the same order, and of all others."""

    left: tuple[int, ...]
    right: tuple[int, ...]
    rest: tuple[int, ...]


def paired(names: Sequence[str], mirrors: Sequence[tuple[str, str]]) -> Pairs:
    """Components whose name begins with a mirror's left side, with those that have its right side there instead.

    The order is that of the mirrors, then of the names; a name without its counterpart is one of the rest.
    """
    at = {n: i for i, n in enumerate(names)}
    found = [(at[n], at[b + n[len(a) :]]) for a, b in mirrors for n in names if n.startswith(a) and b + n[len(a) :] in at]
    taken = {i for pair in found for i in pair}
    if len(taken) != 2 * len(found):
        raise ValueError("a component has two counterparts")
    return Pairs(tuple(a for a, _ in found), tuple(b for _, b in found), tuple(i for i in range(len(names)) if i not in taken))


def families(names: Sequence[str], parts: Sequence[str], mirrors: Sequence[tuple[str, str]]) -> dict[str, tuple[list[int], list[int]]]:
    """A descriptor for each part: all pairs whose left name holds it. Parts without a pair have none."""
    p = paired(names, mirrors)
    found = {part: [(a, b) for a, b in zip(p.left, p.right, strict=True) if part in names[a]] for part in parts}
    return {part: ([a for a, _ in x], [b for _, b in x]) for part, x in found.items() if x}


def descriptors(vector: str, of: dict[str, tuple[list[int], list[int]]]) -> list[Column]:
    """A column for each descriptor: the sum of its left components less that of its right ones. No component is moved."""
    v = F.col(vector)

    def total(at: list[int]) -> Column:
        return F.aggregate(F.array(*map(F.lit, at)), F.lit(0.0), lambda s, i: s + F.get(v, i).cast("double")) if at else F.lit(0.0)

    return [(total(a) - total(b)).alias(name) for name, (a, b) in of.items()]


@dataclass(frozen=True)
class Scale:
    """z = (x - mean) / std * weight; a component that doesn't vary is 0, and comes back as its mean."""

    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray

    def to(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / np.where(self.weight > 0, self.std, 1.0) * self.weight

    def back(self, z: np.ndarray) -> np.ndarray:
        varies = self.weight > 0
        return np.where(varies, z / np.where(varies, self.weight, 1.0) * self.std, 0.0) + self.mean


def scale_of(df: DataFrame, vector: str, blocks: Sequence[str] | None = None) -> Scale:
    """Means and population deviations; with ``blocks``, the block of each component, a block weighs one over the root of its varying ones."""
    found = sorted(linear.feature_stats(df, vector).collect(), key=lambda r: r.dim)  # one row for each component
    mean, std = (np.array([r[c] for r in found], float) for c in ("mean", "std"))
    varies = std > np.maximum(1e-12, np.abs(mean) * 1e-10)
    if blocks is None:
        return Scale(mean, std, varies.astype(float))
    width = {b: sum(v for v, c in zip(varies, blocks, strict=True) if c == b) for b in set(blocks)}
    return Scale(mean, std, np.array([1 / np.sqrt(width[b]) if v else 0.0 for v, b in zip(varies, blocks, strict=True)]))


def matrix(f, vector: Column) -> Column:
    """f of the batch's vectors as a matrix, by an Arrow function; null vectors stay null."""
    linear.importable(SparkSession.active())

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        known = x.dropna()
        found = f(np.stack([np.asarray(v, float) for v in known])) if len(known) else []
        return pd.Series(list(found), known.index, dtype=object).reindex(x.index).where(x.notna(), None)

    return run(vector.cast("array<double>"))


@dataclass(frozen=True)
class Representation:
    """Coordinates are those of (rest, means of pairs) on ``common``, then those of half differences on ``difference``."""

    left: np.ndarray
    right: np.ndarray
    rest: np.ndarray
    rest_mean: np.ndarray
    rest_std: np.ndarray
    rest_weight: np.ndarray
    mean_mean: np.ndarray
    mean_std: np.ndarray
    mean_weight: np.ndarray
    half_mean: np.ndarray
    half_std: np.ndarray
    half_weight: np.ndarray
    common: np.ndarray
    common_energy: np.ndarray
    difference: np.ndarray
    difference_energy: np.ndarray

    def _scale(self, part: str) -> Scale:
        return Scale(*(getattr(self, f"{part}_{n}") for n in ("mean", "std", "weight")))

    def _rows(self, name: str) -> np.ndarray:
        return getattr(self, name).astype(int)

    def normalised(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = x[:, self._rows("left")], x[:, self._rows("right")]
        both = [self._scale("rest").to(x[:, self._rows("rest")]), self._scale("mean").to((a + b) / 2)]
        return np.concatenate(both, axis=1), self._scale("half").to((a - b) / 2)

    def encode(self, x: np.ndarray) -> np.ndarray:
        common, half = self.normalised(x)
        return np.concatenate([common @ self.common, half @ self.difference], axis=1)

    def differences(self, z: np.ndarray) -> np.ndarray:
        """Left less right of each pair, from coordinates."""
        return 2 * self._scale("half").back(z[:, self.common.shape[1] :] @ self.difference.T)

    def decode(self, z: np.ndarray) -> np.ndarray:
        both, half = z[:, : self.common.shape[1]] @ self.common.T, self.differences(z) / 2
        n = len(self.rest)
        rest, mean = self._scale("rest").back(both[:, :n]), self._scale("mean").back(both[:, n:])
        out = np.empty((len(z), n + 2 * len(self.left)))
        out[:, self._rows("rest")], out[:, self._rows("left")], out[:, self._rows("right")] = rest, mean + half, mean - half
        return out

    def shares(self, part: str, blocks: Sequence[str]) -> dict[str, np.ndarray]:
        """Each block's share of every mode of ``common`` or ``difference``; blocks: those of its components."""
        squares = getattr(self, part) ** 2
        return {b: squares[[c == b for c in blocks]].sum(axis=0) for b in dict.fromkeys(blocks)}

    def captured(self, part: str, ranks: Sequence[int]) -> list[tuple[int, float, float]]:
        """(rank, share of energy, reconstruction error)."""
        return linear.captured(linear.Decomposition(getattr(self, part), getattr(self, f"{part}_energy")), list(ranks))

    def digest(self) -> str:
        h = hashlib.sha256(type(self).__name__.encode())
        for f in fields(self):
            v = np.ascontiguousarray(getattr(self, f.name), dtype="<f8")
            h.update(f"{f.name}{v.shape}".encode() + v.tobytes())
        return h.hexdigest()


def fit(df: DataFrame, vector: str, pairs: Pairs, blocks: Sequence[str], ranks: tuple[int, int]) -> Representation:
    """Learns from the rows of df: scales, then bases of so many modes. ``blocks`` are those of all components; they balance the rest."""
    left, right, rest = (np.array(x, int) for x in (pairs.left, pairs.right, pairs.rest))
    known = df.where(F.col(vector).isNotNull())
    halves = known.select(
        F.col(vector).cast("array<double>").alias("x"), matrix(lambda x: (x[:, left] + x[:, right]) / 2, F.col(vector)).alias("m"), matrix(lambda x: (x[:, left] - x[:, right]) / 2, F.col(vector)).alias("h")
    )
    whole = scale_of(halves, "x", blocks)
    scales = {"rest": Scale(*(v[rest] for v in (whole.mean, whole.std, whole.weight))), "mean": scale_of(halves, "m"), "half": scale_of(halves, "h")}
    empty = {f"{p}{e}": np.zeros((0, 0)) for p in ("common", "difference") for e in ("", "_energy")}
    start = Representation(left=left, right=right, rest=rest, **{f"{p}_{n}": getattr(s, n) for p, s in scales.items() for n in ("mean", "std", "weight")}, **empty)
    bases = {}
    for i, (part, rank) in enumerate(zip(("common", "difference"), ranks, strict=True)):
        found = linear.pod(known.select(matrix(lambda x, i=i: start.normalised(x)[i], F.col(vector)).alias("z")), "z", rank)
        bases |= {part: found.basis, f"{part}_energy": found.eigenvalues}
    return Representation(**{f.name: getattr(start, f.name) for f in fields(start)} | bases)


def frozen(spark: SparkSession, what: Representation, path: str) -> str:
    """Writes a representation with its class and digest; one that is there already isn't replaced."""
    digest = what.digest()
    rows = [(type(what).__name__, digest, f.name, [int(n) for n in v.shape], np.ravel(v).astype(float).tolist()) for f in fields(what) for v in [np.asarray(getattr(what, f.name))]]
    spark.createDataFrame(rows, "kind string, digest string, name string, shape array<int>, v array<double>").coalesce(1).write.parquet(path)
    return digest


def thawed(spark: SparkSession, path: str, digest: str | None = None) -> Representation:
    """The representation written at a path; raises where it is of another class, was changed, or isn't the one with ``digest``."""
    rows = spark.read.parquet(path).collect()  # one row for each array
    if {r.kind for r in rows} != {Representation.__name__}:
        raise ValueError(f"no representation at {path}")
    found = Representation(**{r.name: np.array(r.v, float).reshape(r.shape) for r in rows})
    if {r.digest for r in rows} != {found.digest()} or digest not in (None, found.digest()):
        raise ValueError(f"the representation at {path} isn't what was frozen")
    return found
