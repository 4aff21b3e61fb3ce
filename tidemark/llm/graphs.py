"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation (combined before its shuffle) and an equi-join in which the links of one node
are dealt to several tasks; nothing is gathered to the driver. Once at most ``LOCAL_LINKS``
links are left (a bound in memory, not in input), one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column, dropped, importable, saved, spread_join

LOCAL_LINKS = 2_000_000


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Unites the pairs (x, y) in ``root``, which leads each place to the smallest known place of its component."""
    while len(x):
        while (root[root] != root).any():
            root[:] = root[root]
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))


def components(spark: SparkSession, links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v: long); root is the component's smallest node.

    Loops and repeated links don't matter; no links give no rows.
    """
    edges, path = saved(spark, links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = _sign(edges)
    while sign[0] > local_links:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = spread_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after, new_path = saved(spark, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(spark, path)
        edges, path = after, new_path
        sign, before = _sign(edges), sign
        if sign == before:
            break
    else:
        edges = _finished(edges)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found, _ = saved(spark, nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    dropped(spark, path)
    return found


def least_keys(spark: SparkSession, classes: DataFrame, nodes: DataFrame, node: str, first: str) -> DataFrame:
    """(node, component_id) of every class: the smallest ``first`` of the component that ``nodes`` (node, root) put it in, or its own."""
    of = nodes.select(F.col("node").alias(node), "root").join(classes, node)
    least, path = saved(spark, of.groupBy("root").agg(F.min(first).alias("component_id")), "least")
    known = spread_join(of.select(node, "root"), least, "root", node).select(node, "component_id")
    found, _ = saved(spark, classes.join(known, node, "left").select(node, F.coalesce("component_id", first).alias("component_id")), "classes")
    dropped(spark, path)
    return found


def _finished(edges: DataFrame) -> DataFrame:
    """Links from each node but the smallest to the smallest of its component, made in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(column(b, "u").to_numpy(), column(b, "v").to_numpy()) for b in batches]
        if ends:
            u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
            nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = np.arange(len(nodes))
            joined(root, place[: len(u)], place[len(u) :])
            led = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[led]), pa.array(nodes[root[led]])], names=["u", "v"])

    importable(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, "u long, v long")


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
