"""Hard negatives by a pivot table (operator 12).

A vector x becomes (x, sqrt(M - |x|^2)), M being the largest |x|^2, and an anchor a becomes (a, 0): then
|a' - x'|^2 = |a|^2 + M - 2 a.x, so that an inner product is a distance. Each row's distances to ``PIVOTS``
pivots are stored with it. By the triangle inequality they bracket the distance, and so the score, of an anchor
and a row: rows whose bracket leaves what is wanted go, and the scores of the others are made exactly. Pivots are
far points of a bounded sample by hash (``SAMPLE`` rows); every row is in the table.

Rows lie in blocks of at most ``BLOCK``, in the order of their nearest pivot and the distance to it; a hash breaks
ties, so equal vectors are dealt to many tasks. A block has the least and largest distance to each pivot, which
lets an anchor pass over it as a whole. The anchors are a stated query set: they are dealt to groups of ``ANCHORS``,
the blocks to stripes, and a task streams a stripe's blocks past a group, holding one block and the best rows found
so far, whose scores are the bound for the next. There are no more stripes than keep the cluster busy, so that what
tasks give grows with the anchors and not with their product with the rows.

Components are floor(scale * x). Scores are exact: in double precision below 2^53, in 64-bit integers above.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part.
Shorter vectors count as padded with zeros; components are held at +-2^27, which x reaches at 524,288 for a scale of
256. Rows that repeat an id are rows of their own: each is mined if it is an anchor, and is a partner of the others.
An anchor without other rows of its label, or a positive without rows in its range, gives no rows; an empty table
gives none. Other columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, importable, saved

SCALE, PIVOTS, SAMPLE, BLOCK, ANCHORS = 256, 16, 4096, 1024, 4096
#: Blocks of a stripe at least, anchors whose brackets are made at once, and the bound on components.
STRIPE, CHUNK, MOST = 8, 128, 1 << 27
POSITIVES, NEGATIVES = 5, 5
_TABLE = "rows int, ids array<long>, labels array<long>, places array<int>, vectors binary, pivots binary, low array<double>, high array<double>"


def scaled(vector: str, scale: int):
    """The vector's integer components; null where it is null or has a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.lit(scale) * x.cast("double")))).cast("int"))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def padded(lists: pa.Array, width: int) -> np.ndarray:
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int32)
    out[np.arange(width) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Pivots:
    """Augmented pivots, by farthest-first choice; ``most`` is M."""

    def __init__(self, vectors: np.ndarray, most: float, number: int):
        self.most, x = most, self.augmented(vectors.astype(float), most)
        chosen, gap = [], np.full(len(x), np.inf)
        while len(chosen) < min(number, len(x)):
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, np.sqrt(np.maximum(((x - x[chosen[-1]]) ** 2).sum(axis=1), 0)))
        self.points = x[chosen]

    @staticmethod
    def augmented(x: np.ndarray, most: float) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))])

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = np.column_stack([x.astype(float), np.zeros(len(x))]) if anchors else self.augmented(x.astype(float), self.most)
        return np.column_stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.points])


def exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of x; in double precision where every partial sum is an exact integer there."""
    safe = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[-1] < 2.0**53
    kind = np.float64 if safe else np.int64
    return (a.astype(kind) @ x.astype(kind).T).astype(np.int64)


def bracket(of_anchor: np.ndarray, of_row: np.ndarray, norm: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor and row that their distances to the pivots leave."""
    near = np.abs(of_anchor[:, 0, None] - of_row[:, 0])
    far = of_anchor[:, 0, None] + of_row[:, 0]
    for k in range(1, of_anchor.shape[1]):
        np.maximum(near, np.abs(of_anchor[:, k, None] - of_row[:, k]), out=near)
        np.minimum(far, of_anchor[:, k, None] + of_row[:, k], out=far)
    slack = 1 + 1e-9 * (norm[:, None] + most)  # rounding of the distances
    return (norm[:, None] + most - far**2) / 2 - slack, (norm[:, None] + most - near**2) / 2 + slack


class Best:
    """The best rows of each of n lists: score descending, id ascending."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.at, self.score, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.bound = np.full(n, np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.bound[at]
        at, score, ids = (np.concatenate([x, y[good]]) for x, y in ((self.at, at), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        stays = rank < self.most
        last = rank == self.most - 1
        self.bound[at[last]] = score[last]
        self.at, self.score, self.ids = at[stays], score[stays], ids[stays]


class Group:
    """Anchors past which blocks are streamed; positives, or negatives of targets (anchor, score) where there are some."""

    def __init__(self, anchors: list[dict], most: float, top: int, low: int, high: int):
        self.keys = np.array([(a["block"], a["place"]) for a in anchors], np.int64)
        self.ids, self.labels = np.array([a["vec_id"] for a in anchors]), np.array([a["label"] for a in anchors])
        self.vectors, self.pivots = (np.stack([np.frombuffer(a[c], kind) for a in anchors]) for c, kind in (("vector", np.int32), ("pivots", np.float64)))
        self.norm = (self.vectors.astype(float) ** 2).sum(axis=1)
        self.most, self.negatives = most, anchors[0]["targets"] is not None
        targets = [(i, k, t["vec_id"], t["score"]) for i, a in enumerate(anchors) for k, t in enumerate(a["targets"] or [])]
        if self.negatives:
            self.of, self.rank, self.positive, self.top = np.array(targets, np.int64).reshape(-1, 4).T
            self.least = -(-low * self.top // 100)
            self.largest = high * self.top // 100
            self.first = np.searchsorted(self.of, np.arange(len(anchors) + 1))
        self.best = Best(len(targets) if self.negatives else len(anchors), top)

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each anchor still has use for."""
        n = len(self.ids)
        if not self.negatives:
            return self.best.bound, np.full(n, np.iinfo(np.int64).max)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, np.maximum(self.least, self.best.bound))
        np.maximum.at(high, self.of, self.largest)
        return low, high

    def meet(self, block: dict) -> None:
        rows, number = block["rows"], block["block"]
        x, pivots = np.frombuffer(block["vectors"], np.int32).reshape(rows, -1), np.frombuffer(block["pivots"], np.float64).reshape(rows, -1)
        ids, labels, places = (np.array(block[c]) for c in ("ids", "labels", "places"))
        outside = np.maximum(self.pivots - np.array(block["high"]), np.array(block["low"]) - self.pivots).max(axis=1).clip(0)
        low, high = self.wanted()
        reach = (self.norm + self.most - outside**2) / 2 + 1 + 1e-9 * (self.norm + self.most)
        near = np.flatnonzero((reach >= low) & (low <= high))
        for at in range(0, len(near), CHUNK):
            own = near[at : at + CHUNK]
            low, high = (b[own] for b in self.wanted())
            least, largest = bracket(self.pivots[own], pivots, self.norm[own], self.most)
            same = self.labels[own][:, None] == labels
            stays = (largest >= low[:, None]) & (least <= high[:, None]) & (~same if self.negatives else same)
            if not self.negatives:
                stays &= ~((self.keys[own, 0] == number)[:, None] & (self.keys[own, 1][:, None] == places))
            i, j = np.nonzero(stays)
            if not len(i):
                continue
            used, place = np.unique(j, return_inverse=True)
            score = exact(self.vectors[own], x[used])[i, place]
            if not self.negatives:
                self.best.add(own[i], score, ids[j])
                continue
            good = (score >= low[i]) & (score <= high[i])
            i, j, score = own[i[good]], j[good], score[good]
            n = self.first[i + 1] - self.first[i]
            pair = np.repeat(np.arange(len(i)), n)
            target = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[i][pair]
            fits = (score[pair] >= self.least[target]) & (score[pair] <= self.largest[target])
            self.best.add(target[fits], score[pair][fits], ids[j][pair][fits])

    def found(self) -> pa.RecordBatch:
        b = self.best
        i = self.of[b.at] if self.negatives else b.at
        rank, positive, top = (self.rank[b.at], self.positive[b.at], self.top[b.at]) if self.negatives else (b.at * 0,) * 3
        fields = {"block": self.keys[i, 0], "place": self.keys[i, 1].astype(np.int32), "vec_id": self.ids[i], "target": rank, "positive_id": positive, "positive_score": top, "other_id": b.ids, "score": b.score}
        return pa.RecordBatch.from_pydict(fields)


_FOUND = "block long, place int, vec_id long, target long, positive_id long, positive_score long, other_id long, score long"


def pivot_table(rows: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """Blocks of rows (vec_id, label, vector: array<int>) with their distances to the pivots."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded(column(batch, "vector"), width)
            d = pivots.distances(x)
            cell = d.argmin(axis=1) if len(d) else np.empty(0, np.int64)
            fields = {c: column(batch, c) for c in ("vec_id", "label")} | {"cell": cell.astype(np.int32), "gap": d[np.arange(len(d)), cell]}
            fields |= {c: pa.array([r.tobytes() for r in v], pa.binary()) for c, v in (("vector", x), ("pivots", d))}
            yield pa.RecordBatch.from_pydict(fields)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(part: list[tuple]) -> pa.RecordBatch:
            ids, labels, vectors, own = zip(*part, strict=True)
            d = np.stack([np.frombuffer(x, np.float64) for x in own])
            row = {"rows": len(part), "ids": ids, "labels": labels, "places": range(len(part)), "vectors": b"".join(vectors), "pivots": b"".join(own), "low": d.min(axis=0).tolist(), "high": d.max(axis=0).tolist()}
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([list(v) if isinstance(v, (tuple, range)) else v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            held += zip(*(column(batch, c).to_pylist() for c in ("vec_id", "label", "vector", "pivots")), strict=True)
            while len(held) >= BLOCK:
                yield out(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield out(held)

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = rows.mapInArrow(measured, "vec_id long, label long, cell int, gap double, vector binary, pivots binary")
    table = table.withColumn("tie", F.xxhash64("vec_id")).repartitionByRange(parts, "cell", "gap", "tie").sortWithinPartitions("cell", "gap", "tie")
    found, _ = saved(spark, table.mapInArrow(blocks, _TABLE).withColumn("block", F.monotonically_increasing_id()), "blocks")
    return found


def _anchors(blocks: DataFrame, pivots: Pivots, every: int) -> DataFrame:
    """(block, place, vec_id, label, vector, pivots) of the rows whose id ``every`` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = np.array(b["ids"])
                at = np.flatnonzero(ids % every == 0)
                x = np.frombuffer(b["vectors"], np.int32).reshape(b["rows"], -1)[at]
                fields = {"block": np.full(len(at), b["block"]), "place": at.astype(np.int32), "vec_id": ids[at], "label": np.array(b["labels"], np.int64)[at]}
                yield pa.RecordBatch.from_pydict(fields | {c: pa.array([r.tobytes() for r in v], pa.binary()) for c, v in (("vector", x), ("pivots", pivots.distances(x, True)))})

    return blocks.select("block", "rows", "ids", "labels", "vectors").mapInArrow(run, "block long, place int, vec_id long, label long, vector binary, pivots binary")


def _searched(anchors: DataFrame, blocks: DataFrame, most: float, top: int, low: int = 0, high: int = 0) -> DataFrame:
    """The best rows that each task finds for its anchors among its stripe's blocks."""
    spark: SparkSession = anchors.sparkSession
    groups = max(1, -(-anchors.count() // ANCHORS))
    stripes = max(1, min(-(-blocks.count() // STRIPE), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)))
    group, stripe = F.pmod(F.xxhash64("block", "place"), F.lit(groups)).cast("int").alias("group"), F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe")
    ours = anchors.select(F.struct(*anchors.columns).alias("anchor"), F.lit(None).cast(f"struct<{', '.join(f'{n}: {t}' for n, t in blocks.dtypes)}>").alias("one"), group, F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    theirs = blocks.select(F.lit(None).cast(ours.schema["anchor"].dataType).alias("anchor"), F.struct(*blocks.columns).alias("one"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), stripe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, met = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(k)[r].as_py() for k, c in enumerate(batch.schema.names)}
                if (row["group"], row["stripe"]) != key:
                    if met:
                        yield met.found()
                    key, held, met = (row["group"], row["stripe"]), [], None
                if row["anchor"]:
                    held.append(row["anchor"])
                elif held:
                    met = met or Group(held, most, top, low, high)
                    met.meet(row["one"])
        if met:
            yield met.found()

    both = ours.unionByName(theirs).repartition(groups * stripes, "group", "stripe")
    return both.sortWithinPartitions("group", "stripe", F.col("one").isNotNull()).mapInArrow(run, _FOUND)


def hard_negatives(rows: DataFrame, every: int, low: int = 80, high: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rows: (vec_id, label, vector).

    Anchors are the rows whose id ``every`` divides; a positive's negatives are the first of another label that score
    between ``low`` and ``high`` hundredths of its score.
    """
    spark = rows.sparkSession
    importable(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled("vector", scale).alias("vector")).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    width, most = rows.agg(F.max(F.size("vector")), F.max(norm)).first()
    width, most = max(width or 0, 1), most or 0.0
    sample = rows.select("vector", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    found = Pivots(padded(sample, width) if len(sample) else np.zeros((1, width), np.int32), most, pivots)
    blocks = pivot_table(rows, found, width)
    anchors, _ = saved(spark, _anchors(blocks, found, every), "anchors")

    key, search = ["block", "place", "vec_id"], partial(_searched, blocks=blocks, most=most)
    best = Window.partitionBy(*key, "target").orderBy(F.desc("score"), "other_id")
    close = search(anchors.withColumn("targets", F.lit(None).cast("array<struct<vec_id: long, score: long>>")), top=positives)
    ranked = close.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    targets = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "other_id", "score"))).alias("targets"))
    targets = targets.withColumn("targets", F.transform("targets", lambda x: F.struct(x["other_id"].alias("vec_id"), x["score"].alias("score"))))
    aimed, _ = saved(spark, anchors.join(targets, key), "aimed")
    hard = search(aimed, top=negatives, low=low, high=high).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return hard.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
