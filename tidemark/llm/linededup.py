"""Line dedup by distinct-site spread (operator 3).

A line is boilerplate if it occurs on at least ``least_sites`` distinct sites. Lines are told apart by a
64-bit hash of the trimmed text. For each hash, HyperLogLog sketches of its sites are merged by
aggregation, so no task ever holds the sites of one line; where the sketch's estimate is near the
threshold, the exact number of distinct sites decides. Boilerplate is then taken out of every document,
but for its first occurrence: the first line of the document with the smallest key that has it, so that
nothing is lost from the corpus as a whole.

The set of boilerplate hashes is broadcast only if it was counted to hold at most ``broadcast_lines``;
otherwise each document's hashes are joined to it. Both ways give the same rows.

Defined results: a null text stays null and has no lines; blank lines are never boilerplate and always
stay; a null site is no site; rows with a null key never hold a first occurrence; repeated rows are
treated alike; an empty table gives an empty one; other columns of the input are kept.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, column, saved, spread_join, texts, unused

LEAST_SITES, BROADCAST_LINES = 8, 200_000
#: Sketch size (2**12 registers, 1.6 % standard error) and the half-width of the exactly counted band.
LG_K, BAND = 12, 0.25


def line_hashes(text: Column) -> Column:
    """Distinct hashes of the text's lines, without blank ones."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def line_hash(line: str) -> int | None:
    """What line_hashes() has of one line; None for a blank one."""
    line = line.strip(" ")
    if not line:
        return None
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _among(rows: DataFrame, lines: DataFrame, broadcast_lines: int) -> DataFrame:
    """The rows whose ``line`` is among ``lines``, which are broadcast if they are few."""
    lines = lines.select("line")
    return rows.join(F.broadcast(lines) if lines.count() <= broadcast_lines else lines, "line", "left_semi")


def spread(
    docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", least_sites: int = LEAST_SITES, band: float = BAND, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """(line, sites, first: long) of the lines on at least ``least_sites`` sites.

    ``sites`` is exact near the threshold and the sketch's estimate above; ``first`` is the smallest key with the line.
    """
    spark = docs.sparkSession
    lines = docs.select(F.col(key).cast("long").alias("k"), F.col(site).cast("string").alias("site"), F.explode(line_hashes(F.col(text))).alias("line"))
    sketches = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("k").alias("first"))
    wide, _ = saved(spark, sketches.where(F.col("sites") >= least_sites * (1 - band)), "spread")
    near = wide.where(F.col("sites") <= least_sites * (1 + band))
    exact = _among(lines.select("line", "site"), near, broadcast_lines).distinct().groupBy("line").agg(F.count("site").alias("exact"))
    exact = near.join(exact, "line").where(F.col("exact") >= least_sites).select("line", F.col("exact").alias("sites"), "first")
    found, _ = saved(spark, wide.where(F.col("sites") > least_sites * (1 + band)).unionByName(exact), "boilerplate")
    return found


def stripped(docs: DataFrame, boilerplate: DataFrame, key: str = "doc_id", text: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with boilerplate lines taken out of ``text``, and ``n_lines_removed`` (long)."""
    kept = [c for c in docs.columns if c not in (text, "n_lines_removed")]
    lines_of, at = unused(docs, "_lines"), unused(docs, "_at")
    if boilerplate.count() <= broadcast_lines:
        firsts = dict(boilerplate.select("line", "first").toArrow().to_pandas().itertuples(index=False))
        rows = docs.select(*kept, text, F.lit(None).cast("map<long,long>").alias(lines_of))
    else:
        firsts = {}
        hashed = docs.withColumn(at, F.xxhash64(F.col(text)))  # what is found depends on the text alone; lines of another text with its hash do no harm
        places = hashed.select(at, F.explode(line_hashes(F.col(text))).alias("line")).distinct().join(boilerplate.select("line", "first"), "line")
        of = places.groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("line", "first"))).alias(lines_of))
        rows = spread_join(hashed, of, at, key, "left").select(*kept, text, lines_of)

    def make():
        def run(batch):
            out, gone = [], []
            for k, t, found in zip(column(batch, key).to_pylist(), texts(batch, text), column(batch, lines_of).to_pylist(), strict=True):
                t, n = strip_one(k, t, dict(found) if found else firsts)
                out.append(t)
                gone.append(n)
            return {c: column(batch, c) for c in kept} | {text: pa.array(out, pa.string()), "n_lines_removed": pa.array(gone, pa.int64())}

        return run

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return by_batch(rows, rows.columns, make, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{text}` string, n_lines_removed long"]))


def strip_one(key: int | None, text: str | None, firsts: dict[int, int]) -> tuple[str | None, int]:
    """The text without its boilerplate lines but for first occurrences, and how many went."""
    if not text or not firsts:
        return text, 0
    lines, stay, seen = text.split("\n"), [], set()
    for line in lines:
        h = line_hash(line)
        if h in firsts:
            if key is None or firsts[h] != key or h in seen:
                continue
            seen.add(h)
        stay.append(line)
    return ("\n".join(stay) if len(stay) < len(lines) else text), len(lines) - len(stay)


def dedup(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", least_sites: int = LEAST_SITES) -> DataFrame:
    return stripped(docs, spread(docs, key, site, text, least_sites), key, text)
