"""SimHash near-duplicates by tiled exact comparison (operator 10).

Equal fingerprints are first reduced to one. The distinct ones are laid out in tiles of equal population
counts: the 64 bits are read as lanes, and a tile holds fingerprints whose lanes have the same counts of
ones. Since two fingerprints differ in at least as many bits as their lane counts do in sum, only pairs of
tiles whose counts differ by no more than the radius are compared, bit by bit (exclusive-or and bit count
in numpy); all others are skipped without loss. Lanes grow finer until the fullest cell is small, and a
cell that is still too full is split into as many tiles as it needs, each pair of which is compared by its
own row, so no task depends on the size of a group. Pairs of cells are found by their numbers alone; the
fingerprints join only those that exist. Each pair of tiles gives a spanning forest of the links it finds,
never all pairs of a group; components come from the forests' union.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like any
other; one or two words are hashed as a whole; a bit set in exactly half of the hashes is 0; repeated rows
get equal results; an empty table gives an empty one; other columns of the input play no part.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, column, dropped, saved, spread_join, texts
from tidemark.llm.graphs import components, joined, least_keys

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints that a tile holds at most, but for the unevenness of hashing; lanes to choose from.
TILE, LANES = 8192, (2, 4, 8)
_STEP = 1 << 20  # pairs that are compared at once


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    parts = map(b" ".join, zip(*(w[i:] for i in range(shingle_words)), strict=False)) if len(w) >= shingle_words else [b" ".join(w)]
    n = max(1, len(w) - shingle_words + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(key, fp: long) of every row."""

    def make():
        return lambda b: {key: column(b, key), "fp": np.array([fingerprint(x, shingle_words, seed) for x in texts(b, text)], np.uint64).view(np.int64)}

    return by_batch(df, [F.col(key).cast("long").alias(key), text], make, f"{key} long, fp long")


def offsets(lanes: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of lane counts within the radius, each unordered pair of cells once."""
    found = {(0,) * lanes}
    for _ in range(radius):
        found |= {tuple(x + s * (i == k) for i, x in enumerate(o)) for o in found for k in range(lanes) for s in (-1, 1)}
    return sorted(o for o in found if o >= (0,) * lanes)


def cell(lanes: int):
    """A fingerprint's lane counts as one number."""
    width = 64 // lanes
    low = F.lit((1 << width) - 1).cast("long")
    return sum((F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(low)).cast("long") * 65**k for k in range(lanes)), F.lit(0).cast("long"))


def linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links between two tiles, or within one."""
    both = a if same else np.concatenate([a, b])
    root = np.arange(len(both))
    step = max(1, _STEP // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        if len(x):
            joined(root, x + i, y if same else y + len(a))
    u = np.flatnonzero(root != np.arange(len(both)))
    return both[u], both[root[u]]


def links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, lanes: tuple[int, ...] = LANES) -> DataFrame:
    """(u, v): a forest of the links between the distinct fingerprints ``fp``."""
    for n in lanes:
        fullest = distinct.groupBy(cell(n).alias("c")).count().agg(F.max("count")).first()[0] or 0
        if fullest <= tile:
            break
    cells, _ = saved(spark, distinct.groupBy(cell(n).alias("cell")).agg(F.ceil(F.count("*") / tile).alias("parts")), "cells")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")
    tiles, _ = saved(spark, distinct.withColumn("cell", cell(n)).join(cells, "cell").groupBy("cell", part).agg(F.collect_list("fp").alias("fps")), "tiles")
    # pairs of cells that exist, by their numbers alone; then pairs of their tiles; the fingerprints come last
    near = F.array(*[F.col("c") + F.lit(sum(x * 65**k for k, x in enumerate(o))).cast("long") for o in offsets(n, radius)])
    two = cells.select(F.col("cell").alias("c"), F.col("parts").alias("p")).withColumn("cell", F.explode(near)).join(cells, "cell")
    of = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.col(x) - 1))
    two = two.withColumn("i", of("p")).withColumn("j", of("parts")).where("c <> cell or i <= j").select("c", "i", "cell", F.col("j").alias("part"))
    left = tiles.select(F.col("cell").alias("c"), F.col("part").alias("i"), F.col("fps").alias("a"))
    pairs = two.join(left, ["c", "i"]).join(tiles, ["cell", "part"]).select("a", F.col("fps").alias("b"), F.expr("c = cell and i = part").alias("same"))

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            a, b, same = (column(batch, x) for x in ("a", "b", "same"))
            u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for i in range(batch.num_rows):
                x, y = linked(a[i].values.to_numpy().view(np.uint64), b[i].values.to_numpy().view(np.uint64), same[i].as_py(), radius)
                u.append(x)
                v.append(y)
            return {"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)}

        return run

    return by_batch(pairs, ["a", "b", "same"], make, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE, lanes: tuple[int, ...] = LANES, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp: long, component_id: long): fingerprint and smallest key of the component of every row."""
    spark = df.sparkSession
    prints, _ = saved(spark, fingerprints(df, key, text, shingle_words), "fingerprints")
    groups, groups_path = saved(spark, prints.groupBy("fp").agg(F.min(key).alias("first")), "groups")
    found, path = saved(spark, links(spark, groups.select("fp"), radius, tile, lanes), "forest")
    nodes = components(spark, found)
    dropped(spark, path)
    classes = least_keys(spark, groups, nodes, "fp", "first")
    dropped(spark, groups_path)
    return spread_join(prints, classes, "fp", key).select(key, "fp", "component_id")
