"""Whose error it is: stages replayed in several worlds, in each of which some delays are predicted and the others observed.

All worlds come from one pass over the requests, each as a key of the same intervals and deltas; the world in which
everything is observed is what the others are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stats import nrmse
from tidemark.operators.time import dense_inventory

#: Worlds: whether the handoff and the waiting are predicted in it.
WORLDS = {"observed": (False, False), "handoff": (True, False), "waiting": (False, True), "both": (True, True)}


def worlds(rows: DataFrame) -> DataFrame:
    """rows (route_ns, ready_ns, admission_ns, terminal_ns, handoff_ns, waiting_ns: predicted delays) as intervals of each world.

    Gives the other columns with (world, stage, start_ns, end_ns). A predicted delay is never negative; a request ends when
    it did, but not before it is admitted.
    """
    own = [c for c in rows.columns if c not in ("route_ns", "ready_ns", "admission_ns", "terminal_ns", "handoff_ns", "waiting_ns")]
    delay = lambda predicted, c, observed: F.greatest(F.col(c), F.lit(0)) if predicted else observed
    each = F.explode(F.array(*(
        F.struct(F.lit(w).alias("world"), delay(h, "handoff_ns", F.col("ready_ns") - F.col("route_ns")).alias("h"), delay(q, "waiting_ns", F.col("admission_ns") - F.col("ready_ns")).alias("q"))
        for w, (h, q) in WORLDS.items()
    )))
    found = rows.withColumn("_w", each).select(*own, F.col("_w.world").alias("world"), "route_ns", (F.col("route_ns") + F.col("_w.h")).alias("_a"), (F.col("route_ns") + F.col("_w.h") + F.col("_w.q")).alias("_b"), "terminal_ns")
    of = lambda stage, start, end: F.struct(F.lit(stage).alias("stage"), start.alias("start_ns"), end.alias("end_ns"))
    stages = F.array(of("handoff", F.col("route_ns"), F.col("_a")), of("waiting", F.col("_a"), F.col("_b")), of("running", F.col("_b"), F.greatest("terminal_ns", "_b")))
    return found.select(*own, "world", F.explode(stages).alias("x")).select(*own, "world", "x.*")


def errors(intervals: DataFrame, keys: list[str], period: int, last: int) -> DataFrame:
    """(world, stage, n, nrmse, bias, exact) of the inventories of each world against the observed ones, at boundaries where any world has some.

    keys: what inventories are kept apart by, besides the stage; last: the last boundary.
    """
    stock = dense_inventory(intervals, [*keys, "stage", "world"], "start_ns", "end_ns", period, {"n": F.lit(1).cast("long")}, last)
    wide = stock.groupBy(*keys, "stage", "k").pivot("world", list(WORLDS)).agg(F.sum("n")).fillna(0)
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("world"), F.col(w).cast("double").alias("p")) for w in WORLDS)))
    rows = wide.select("stage", F.col("observed").cast("double").alias("a"), each.alias("x")).select("stage", "a", "x.*")
    e = F.col("p") - F.col("a")
    return rows.groupBy("world", "stage").agg(F.count("*").alias("n"), nrmse(F.col("a"), F.col("p")).alias("nrmse"), F.avg(e).alias("bias"), F.avg((F.abs(e) < 1e-9).cast("double")).alias("exact"))


def shares(found: DataFrame) -> DataFrame:
    """(stage, handoff, waiting, both): errors side by side, by stage."""
    return found.groupBy("stage").pivot("world", ["handoff", "waiting", "both"]).agg(F.first("nrmse"))
