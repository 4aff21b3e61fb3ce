"""SimHash near duplicates whose links are verified on the texts (operator 10 with a check by exact Jaccard).

Texts are linked if their sets of five-word shingles have a Jaccard of 0.8 or more. Equal sets are first
reduced to one text. The others are candidates by their fingerprints: at that similarity a fingerprint
differs in about ten bits, and ``RADIUS`` allows for more than twice as many. Fingerprints of short texts scatter more, so
sets of at most ``FEW`` shingles are candidates whatever their bits. Without more, a radius that wide would
compare everything with everything, so tiles are cut first: each set has ``BANDS`` keys, each the hash of
``BAND_ROWS`` minima of the set under as many orders, and texts are in a common tile where they have a key in
common. What is lost, of pairs at exactly 0.8: about three in a hundred thousand have no key in common, and of those
with more than ``FEW`` shingles fewer than one in a hundred thousand differs in more bits than the radius (tests
measure both); of more similar pairs fewer yet. Texts that only quote the same passage hardly ever have a key in common.

First, each text meets one hub of each of its keys, so that a group of like texts gives as many candidates
as it has texts, and whole sets decide on each. What is then left are keys whose texts are still in different
components. Texts that such keys connect are one group if a tile holds them; otherwise each of their keys is a
group. A group is laid out in tiles in the order of population counts, ties dealt by hash, and pairs of its tiles
whose counts are further apart than the radius are skipped before any set is sent. In a tile, or between two,
fingerprints are compared in numpy by exclusive-or and bit counts, whole sets decide on the candidates at once, and
what leaves the tile is a forest of the links that hold, never pairs of a group.

Defined results: A-Z is folded; texts with fewer words than a shingle are hashed as a whole; a null or empty
text has no words, and texts without words are equal; repeated rows get equal results, rows with a null key
are linked like others but never give a component its number unless it has no other; an empty table gives an
empty one; other columns of the input play no part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, PIECE_BYTES, by_batch, column, dropped, freed, importable, lists, mixed, saved, spread_join, texts
from tidemark.llm.graphs import components, least_keys

SHINGLE_WORDS, SEED = 5, 42
#: Bits that fingerprints of like texts may differ in; rows of a tile at most, but for the unevenness of hashing.
RADIUS, TILE = 24, 2048
#: Shingles up to which sets are candidates whatever their fingerprints.
FEW = 32
#: Keys of a set, and minima in each.
BANDS, BAND_ROWS = 20, 4
#: Rounds in which texts meet hubs.
STARS = 2


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted different hashes."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(shingle_words)), strict=False)) if len(w) >= shingle_words else [b" ".join(w)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64))


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


_ORDERS = np.random.default_rng(10).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def keys_of(h: np.ndarray) -> np.ndarray:
    """A key for each band of a set that isn't empty."""
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, ((h[i : i + 2048, None] ^ _ORDERS) * _ODD).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = mixed(out * _ODD + rows[:, k])
    return out


def sets(df: DataFrame, key: str, text: str, shingle_words: int) -> DataFrame:
    """(key, p: long, h: binary) of every row: p tells equal sets."""

    def make():
        def run(batch):
            h = [shingles(x, shingle_words).tobytes() for x in texts(batch, text)]
            return {key: column(batch, key), "p": np.fromiter(map(xxhash.xxh3_64_intdigest, h), np.uint64, len(h)).view(np.int64), "h": pa.array(h, pa.binary())}

        return run

    return by_batch(df, [F.col(key).cast("long").alias(key), text], make, f"{key} long, p long, h binary")


def prints(df: DataFrame, key: str, text: str, shingle_words: int) -> DataFrame:
    """(key, p, fp: long, n: long, s: array<long>) of every row: fingerprint, size and keys of its set; a set that the task has met before has no keys."""

    def make():
        seen: set[int] = set()

        def run(batch):
            h = [shingles(x, shingle_words) for x in texts(batch, text)]
            p = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in h), np.uint64, len(h)).view(np.int64)
            s = []
            for x, k in zip(h, p.tolist(), strict=True):
                new = len(x) and k not in seen
                seen.add(k)
                s.append(keys_of(x).view(np.int64) if new else np.zeros(0, np.int64))
            if len(seen) > 500_000:
                seen.clear()
            n = np.array([len(x) for x in s], np.int64)
            return {key: column(batch, key), "p": p, "fp": np.array([fingerprint(x) for x in h], np.uint64).view(np.int64), "n": np.array([len(x) for x in h], np.int64), "s": lists(np.concatenate([np.zeros(0, np.int64), *s]), n, pa.int64())}

        return run

    return by_batch(df, [F.col(key).cast("long").alias(key), text], make, f"{key} long, p long, fp long, n long, s array<long>")


def similar(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets ``whole`` (p, h) have a Jaccard of 0.8 or more."""
    if pairs.count() <= BROADCAST_ROWS:
        asked = pairs.select(F.col("u").alias("p")).unionByName(pairs.select(F.col("v").alias("p"))).distinct()
        whole = whole.join(F.broadcast(asked), "p", "left_semi")
    a, b = (whole.select(F.col("p").alias(x), F.col("h").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    both = spread_join(pairs, b, "v", "u").join(a, "u")  # many texts u have the same hub v, few hubs have the same text

    def make():
        def run(batch):
            a, b = column(batch, "a"), column(batch, "b")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(z[i].as_buffer(), np.uint64) for z in (a, b))
                good[i] = 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
            return {c: column(batch, c).to_numpy()[good] for c in ("u", "v")}

        return run

    return by_batch(both, ["u", "v", "a", "b"], make, "u long, v long")


def forest(p: np.ndarray, fp: np.ndarray, c: np.ndarray, h: list[np.ndarray], left: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that hold and join components c: between the texts that are ``left`` and the others, or among all if all are left."""
    n = np.array([len(x) for x in h])
    _, ids = np.unique(np.concatenate(h), return_inverse=True)
    doc = np.repeat(np.arange(len(h)), n)
    ends = np.searchsorted(np.sort(ids), np.arange(ids.max() + 2))
    holders = doc[np.argsort(ids, kind="stable")]  # the texts that have each shingle
    starts = np.cumsum(n) - n
    names, group = np.unique(c, return_inverse=True)
    root = np.arange(len(names))
    out = []
    same = bool(left.all())
    for i in np.flatnonzero(left):
        near = np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= radius
        if n[i] <= FEW:
            near |= n <= FEW
        near &= root[group] != root[group[i]]
        near &= np.arange(len(p)) > i if same else ~left
        if not near.any():
            continue
        mine = ids[starts[i] : starts[i] + n[i]]
        many = ends[mine + 1] - ends[mine]
        at = np.repeat(ends[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(holders[at], minlength=len(p))
        for k in np.flatnonzero(near & (9 * shared >= 4 * (n + n[i]))):
            a, b = root[group[i]], root[group[k]]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                out.append((int(p[i]), int(p[k])))
    return out


def tiled(rows: DataFrame, whole: DataFrame, radius: int, tile: int) -> tuple[DataFrame, list[str]]:
    """(u, v): a forest of the links among texts of rows (s, p, fp, n, c) that keys s in several components connect, and the tables that it reads; whole: (p, h)."""
    spark = rows.sparkSession
    paths: list[str] = []

    def kept_as(df: DataFrame, name: str) -> DataFrame:
        found, path = saved(spark, df, name)
        paths.append(path)
        return found

    open_ = kept_as(rows.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("p").alias("hub")).where("lo <> hi").select("s", "hub"), "open")
    kept = kept_as(spread_join(rows, open_, "s", "p"), "kept")
    nodes = components(spark, kept.select(F.col("p").alias("u"), F.col("hub").alias("v")))
    led = kept_as(kept.select("p").distinct().join(nodes.select(F.col("node").alias("p"), F.col("root").alias("g")), "p"), "led")
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") * 8 * tile / PIECE_BYTES))  # a tile is full by its texts or by their bytes
    texts_ = kept_as(kept.select("p", "fp", "n", "c").distinct().join(led, "p").withColumn("w", weight), "texts")
    large = kept_as(texts_.groupBy("g").agg(F.sum("w").alias("_w")).where(F.col("_w") > tile).select("g"), "large")
    by_key = spread_join(texts_.select("p", "g"), large, "g", "p", "left_semi").select("p")
    by_key = kept.select("s", "p", "fp", "n", "c").join(by_key, "p", "left_semi").withColumn("w", weight).select("p", "fp", "n", "c", "w", F.xxhash64("s", F.lit("key")).alias("g"))
    ones = F.bit_count("fp").alias("ones")
    grouped = kept_as(spread_join(texts_, large, "g", "p", "left_anti").unionByName(by_key).select("g", "p", "fp", "n", "c", "w", ones), "grouped")
    # tiles in the order of population counts; what has the same count is dealt by hash
    counts = grouped.groupBy("g", "ones").agg(F.sum("w").alias("_w"))
    before = F.coalesce(F.sum("_w").over(W.partitionBy("g").orderBy("ones").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = kept_as(counts.select(F.xxhash64("g", "ones").alias("cell"), "_w", before.alias("_before")), "places")
    part = F.floor((F.col("_before") + F.pmod(F.xxhash64("p"), F.col("_w"))) / tile)
    laid = kept_as(spread_join(grouped.withColumn("cell", F.xxhash64("g", "ones")), places, "cell", "p").select("g", "p", "fp", "n", "c", "ones", part.alias("part")), "laid")
    tiles = laid.groupBy("g", "part").agg(F.min("ones").alias("lo"), F.max("ones").alias("hi"), F.min("n").alias("least"))
    left = tiles.select("g", F.col("part").alias("i"), F.col("hi").alias("_hi"), F.col("least").alias("_least"))
    near = (F.col("lo") - F.col("_hi") <= radius) | (F.greatest("least", "_least") <= FEW)
    pairs = left.join(tiles, "g").where((F.col("i") <= F.col("part")) & near).select("g", "i", F.col("part").alias("j"))
    turns = pairs.withColumn("part", F.explode(F.array_distinct(F.array("i", "j")))).groupBy("g", "part").agg(F.collect_list(F.struct("i", "j")).alias("turns"))  # as many as the group has tiles
    turns = kept_as(turns.select(F.xxhash64("g", "part").alias("tile"), "turns"), "turns")
    placed = spread_join(laid.withColumn("tile", F.xxhash64("g", "part")), turns, "tile", "p").join(whole, "p").withColumn("t", F.explode("turns"))
    placed = placed.select("g", "t.i", "t.j", (F.col("part") == F.col("t.i")).alias("left"), "p", "fp", "c", "h")
    buckets = max(1, int(laid.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * 8 // PIECE_BYTES)
    deal = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("g"), F.lit(buckets))).otherwise(F.xxhash64("g", "i", "j"))

    def run(t: pa.Table) -> pa.Table:
        g, i, j = (t[x].to_numpy() for x in ("g", "i", "j"))
        p, fp, c = (t[x].to_numpy() for x in ("p", "fp", "c"))
        left = t["left"].to_numpy(zero_copy_only=False)
        found = []
        order = np.lexsort((p, j, i, g))
        breaks = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (g, i, j)], axis=0)) + 1
        h = t["h"].combine_chunks()
        for at in np.split(order, breaks):
            if left[at].any():
                found += forest(p[at], fp[at], c[at], [np.frombuffer(h[int(k)].as_buffer(), np.uint64) for k in at], left[at], radius)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    importable(spark)
    return placed.groupBy(deal.alias("deal"), F.expr("i = 0 and j = 0").alias("whole")).applyInArrow(run, "u long, v long"), paths


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, tile: int = TILE, stars: int = STARS) -> DataFrame:
    """(key, component_id: long): smallest key of the component of every row."""
    spark = df.sparkSession
    found, found_path = saved(spark, prints(df, key, text, shingle_words), "prints")
    groups, groups_path = saved(spark, found.groupBy("p").agg(F.min(key).alias("first")), "groups")
    rows = found.select(F.explode("s").alias("s"), "p", "fp", "n").withColumn("c", F.col("p"))
    keys = found.select(key, "p")

    def hubs(of: DataFrame, turn: int) -> DataFrame:
        """The text of each key whose hash is least, where the key has texts in several components."""
        hub = F.min(F.struct(F.xxhash64(F.lit(turn), "p").alias("x"), F.col("p").alias("p2"), F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("c").alias("c2"))).alias("hub")
        return of.groupBy("s").agg(hub, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s", "hub.*")

    def met(of: DataFrame) -> DataFrame:
        near = f"c <> c2 and 5 * least(n, n2) >= 4 * greatest(n, n2) and (bit_count(fp ^ fp2) <= {radius} or greatest(n, n2) <= {FEW})"
        return of.where(near).select(F.col("p").alias("u"), F.col("p2").alias("v"), "x")

    first_hubs, hubs_path = saved(spark, hubs(rows, 0), "hubs")
    freed(spark)
    joined, joined_path = saved(spark, spread_join(rows, first_hubs, "s", "p"), "shared")
    dropped(spark, hubs_path)
    freed(spark)  # here and below: steps' shuffles are as large as the texts
    shared = joined.select("s", "p", "fp", "n", "c").distinct()
    asked = joined.select("p").distinct().join(groups, "p").select(F.col("first").alias("_first")).distinct()
    of = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias(text)).join(asked, F.equal_null("_key", "_first"), "left_semi").withColumnRenamed("_key", key)
    whole, whole_path = saved(spark, sets(of, key, text, shingle_words).select("p", "h"), "whole")
    if whole.count() > whole.select("p").distinct().count():  # rows that repeat a key
        whole = whole.dropDuplicates(["p"])
    freed(spark)

    links, paths = None, []

    def linked(more: DataFrame) -> DataFrame:
        nonlocal links
        links = more if links is None else links.unionByName(more)
        return components(spark, links)

    for turn in range(stars):
        if turn == 0:  # each text and the least of its hubs
            one = met(joined).groupBy("u").agg(F.min(F.struct("x", "v")).alias("m")).select("u", "m.v")
        else:
            some, some_path = saved(spark, hubs(shared, turn), "hubs")
            paths.append(some_path)
            one = met(spread_join(shared, some, "s", "p")).select("u", "v")
        pairs, pairs_path = saved(spark, one.distinct(), "pairs")
        more, more_path = saved(spark, similar(pairs, whole), "similar")
        dropped(spark, pairs_path)
        paths.append(more_path)
        nodes = linked(more)
        after = shared.drop("c").join(nodes.select(F.col("node").alias("p"), F.col("root").alias("c")), "p", "left")
        after, new_path = saved(spark, after.select("s", "p", "fp", "n", F.coalesce("c", "p").alias("c")), "shared")
        dropped(spark, joined_path)
        shared, joined_path = after, new_path
        freed(spark)
    links_left, read = tiled(shared, whole, radius, tile)
    more, more_path = saved(spark, links_left, "tiled")
    dropped(spark, *read)
    paths.append(more_path)
    nodes = linked(more)
    freed(spark)
    dropped(spark, joined_path, whole_path, *paths)
    classes = least_keys(spark, groups, nodes, "p", "first")
    dropped(spark, groups_path)
    return spread_join(keys, classes, "p", key).select(key, "component_id")
