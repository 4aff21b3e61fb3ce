"""Scans whose choice is frozen before the test is read.

The rows of a split are only given in order: a scan sees what it learns from and what it validates on; its candidates and
the choice among them are written once, with a digest; from then on the test's rows can be read, and nothing can be scanned.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import linear, selection, time
from tidemark.sources import sinks


class NotFrozen(RuntimeError):
    """The test was asked for before there is a choice, or after its candidates were changed."""


class Frozen(RuntimeError):
    """There is a choice already: the scan is over."""


def _digest(rows: list[str], chosen: str) -> str:
    return hashlib.sha256("\n".join([*sorted(rows), chosen]).encode()).hexdigest()


@dataclass
class Protocol:
    """One scan over a table with a column that tells the split; path: a folder of its own, for its candidates and its choice."""

    spark: SparkSession
    path: str
    table: DataFrame
    split: str = "split"
    test: str = "test"

    def rows(self, *splits: str) -> DataFrame:
        """The rows of splits; the filter reaches the table's scan. Those of the test only once the choice is frozen."""
        if self.test in splits:
            self.choice()
        return self.table.where(F.col(self.split).isin(*splits))

    def _written(self) -> tuple[list[str], str, str] | None:
        found = sinks.read_table(self.spark, f"{self.path}/choice", "kind string, row string, digest string").collect()  # a row for each candidate
        if not found:
            return None
        (chosen,) = [r for r in found if r.kind == "choice"]
        return [r.row for r in found if r.kind == "candidate"], chosen.row, chosen.digest

    def freeze(self, candidates: list[dict], choose: Callable[[list[dict]], dict]) -> dict:
        """Writes the candidates and the one that is chosen."""
        if self._written():
            raise Frozen(f"{self.path} has a choice")
        rows, chosen = [json.dumps(c, sort_keys=True) for c in candidates], json.dumps(choose(candidates), sort_keys=True)
        if chosen not in rows:
            raise ValueError("the choice is none of the candidates")
        digest = _digest(rows, chosen)
        found = [("candidate", r, digest) for r in rows] + [("choice", chosen, digest)]
        self.spark.createDataFrame(found, "kind string, row string, digest string").coalesce(1).write.parquet(f"{self.path}/choice")
        return json.loads(chosen)

    def choice(self) -> dict:
        found = self._written()
        if not found:
            raise NotFrozen(f"{self.path} has no choice")
        rows, chosen, digest = found
        if chosen not in rows or _digest(rows, chosen) != digest:
            raise NotFrozen(f"the choice at {self.path} was changed")
        return json.loads(chosen)

    def candidates(self) -> list[dict]:
        found = self._written()
        return [json.loads(r) for r in found[0]] if found else []


def stable(candidates: list[dict], tolerance: float, radius: float = 1.0) -> dict:
    """The parsimonious one of those whose ``radius``, where they have one, is at most so large."""
    found = [c for c in candidates if c.get("radius", 0.0) <= radius]
    if not found:
        raise ValueError("no stable candidate")
    return selection.parsimonious(found, tolerance)


def retained(plain: dict, richer: dict | None, improvement: float, growth: float) -> bool:
    """Whether a richer family's winner replaces the plain one: its validation error is smaller by a share, its radius greater by no more than ``growth``."""
    if richer is None:
        return False
    gain = (plain["validation"] - richer["validation"]) / max(plain["validation"], 1e-30)
    return gain >= improvement and richer["radius"] <= plain["radius"] + growth


def scanned(p: Protocol, x: str, y: str, penalties: list[float], ranks: list[int], tolerance: float, parts: tuple[str, str] = ("train", "validation"), state: bool = False) -> dict:
    """Ridge models of y on the first components of x by rank and penalty: scanned by moments and frozen.

    With ``state``, x begins with the state whose next one is y: candidates have their spectral radius, and unstable ones aren't chosen.
    """
    if p.candidates():
        raise Frozen(f"{p.path} has a choice")
    a, b = (selection.moments(p.rows(part), x, y) for part in parts)
    found = []
    for rank in ranks:
        for penalty in penalties:
            model = selection.solved(a, penalty, rank)
            row = {"rank": rank, "penalty": penalty, "train": selection.error(a, model), "validation": selection.error(b, model)}
            found.append(row | ({"radius": linear.spectral_radius(model.theta[1 : model.theta.shape[1] + 1].T)} if state else {}))
    return p.freeze(found, lambda c: stable(c, tolerance))


def tested(p: Protocol, x: str, y: str, learned: tuple[str, ...] = ("train", "validation")) -> dict:
    """The frozen choice, learned again from all but the test, with its error and its skill against the mean on the test."""
    chosen = p.choice()
    a, b = selection.moments(p.rows(*learned), x, y), selection.moments(p.rows(p.test), x, y)
    model = selection.solved(a, chosen["penalty"], chosen["rank"])
    mean = selection.error(b, selection.solved(a, 1.0, 0))
    error = selection.error(b, model)
    return chosen | {"test": error, "skill": 1 - error / max(mean, 1e-30)}


def slow_rows(df: DataFrame, keys: list[str], order: str, factor: int, features: list[str], targets: list[str]) -> DataFrame:
    """(keys, block, x, y): means of the features and sums of the targets over full blocks of rows, for a head that predicts the slow from the fast."""
    sums = time.block_sum(df, keys, order, factor, [*features, *targets])
    of: Callable[[list[str], float], Column] = lambda names, by: F.array(*((F.col(c).cast("double") / by) for c in names))
    return sums.select(*keys, "block", of(features, factor).alias("x"), of(targets, 1.0).alias("y"))
