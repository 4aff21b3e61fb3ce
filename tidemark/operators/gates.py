"""Gates on how a state answers to control: authority in a pilot, interpolation and robustness on held-out runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import stats

#: The least effect (Cohen's d) of a response; the least correlations of routes and of the best state with the level.
EFFECT, ROUTE, STATE = 0.25, 0.7, 0.5


def _sure(c: Column) -> Column:
    """What is unknown fails."""
    return F.coalesce(c, F.lit(False))


def responses(rows: DataFrame, keys: list[str], level: str, value: str, low: object, high: object) -> DataFrame:
    """(keys, low, high, effect): the means at two levels of control and Cohen's d between them."""
    at = lambda v: F.avg(F.when(F.col(level) == F.lit(v), F.col(value)))
    means = rows.groupBy(*keys).agg(at(low).alias("low"), at(high).alias("high"))
    return stats.joined_by(means, stats.cohen_d(rows, keys, level, value, low, high).select(*keys, "effect"), keys)


def answers() -> Column:
    """Whether a response rises, and by enough."""
    return _sure((F.col("high") > F.col("low")) & (F.col("effect") >= EFFECT))


def authority(found: DataFrame, point: list[str], run: str, least: int = 2) -> DataFrame:
    """(point, runs, passed, ok) of responses of several signals: a run passes with one that answers, a working point with ``least`` runs."""
    runs = found.groupBy(*point, run).agg(F.max(answers()).alias("_ok"))
    return runs.groupBy(*point).agg(F.count("*").alias("runs"), F.count_if("_ok").alias("passed")).withColumn("ok", F.col("passed") >= least)


def interpolated(found: DataFrame, known: DataFrame, point: list[str], run: str, signal: str, route: str, margin: float = 0.2) -> DataFrame:
    """(point, run, route_ok, state_ok): routes rise with control, and one other signal answers between the means that are known of its point.

    Both are responses by signal; a mean may leave the known range by ``margin`` of its width. A point nobody knows fails.
    """
    k = known.select(*point, signal, F.col("low").alias("_l"), F.col("high").alias("_h"))
    rows = found.join(k, [*point, signal], "left").withColumn("_m", margin * F.abs(F.col("_h") - F.col("_l")))
    inside = (F.col("_l") - F.col("_m") <= F.col("low")) & (F.col("high") <= F.col("_h") + F.col("_m"))
    routes = F.col(signal) == route
    return rows.groupBy(*point, run).agg(_sure(F.max(F.when(routes, _sure(F.col("high") > F.col("low"))))).alias("route_ok"), _sure(F.max(F.when(~routes, answers() & _sure(inside)))).alias("state_ok"))


def robust(rows: DataFrame, keys: list[str], level: str, route: str, states: list[str]) -> DataFrame:
    """(keys, route, state, ok): correlations of the level with the routes and with the best state; rows: one for each level of a key."""
    g = rows.groupBy(*keys).agg(stats.pearson(level, route).alias("route"), *(stats.pearson(level, s).alias(f"_{i}") for i, s in enumerate(states)))
    best = F.greatest(*(F.col(f"_{i}") for i in range(len(states)))) if len(states) > 1 else F.col("_0")
    return g.select(*keys, "route", best.alias("state"), reduce(and_, (_sure(F.col("route") >= ROUTE), _sure(best >= STATE))).alias("ok"))
