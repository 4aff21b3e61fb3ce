"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 1).

Nearness is the inner product. Equal vectors are first reduced to one point that keeps its smallest ids,
as many as an answer can hold, so that copies crowd neither graph nor answers. The graph gives each point
its ``NEIGHBOURS`` nearest found. It starts from exact neighbours within groups of points whose signs
under random directions agree or are dealt together by hash (so that no point is without), and is then improved by NN-descent: a join of the graph with itself brings
together, at each point, its neighbours and those that have it as neighbour, and neighbours of neighbours
that are nearer than a point's worst replace it. Rounds end when hardly anything changes.

A query is a point of the index; greedy search starts there, keeps its ``BEAM`` best points, and in each
hop opens the ``OPENED`` best that weren't open yet, by a join with the graph's lists, until none is left.
Queries travel to the lists, not the lists to the queries; a list that more than ``HOT_ROWS`` queries open in one
hop is copied, and they are dealt to its copies. At last, the beam is scored anew in double
precision on the original vectors.

All tables are partitioned by the hash of a point in buckets of bounded size; nothing goes to the driver
but counts. Each step's plans and tasks are garbage in the driver, which is collected after each table that is saved. The graph's lists carry vectors in half precision, each with a power of two of its own.

Defined results: vectors that are null or zero, or have null or non-finite components, and rows with a
null id take no part; vectors of another length than the most frequent one take no part either; of rows
that repeat an id, the smallest vector counts; ties go to the smaller id; a query whose part of the graph
holds fewer points than an answer gets as many as it holds, one without candidates gets no rows; an empty table gives an empty one; other columns of the input play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, by_batch, column, dropped, freed, importable, lists, mixed, saved

NEIGHBOURS, BEAM, OPENED, TOP = 24, 800, 100, 20
#: Points of a bucket, of a group at the start, groupings at the start, rounds, share of changes that ends them.
BUCKET, GROUP, STARTS, ROUNDS, LEAST_CHANGE = 2048, 512, 3, 5, 0.01
#: Reverse neighbours that join at a point in a round, and nearest candidates that a point takes from one meeting.
REVERSE, TAKEN = 24, 5
#: Queries that open one copy of a list in one hop, but for the unevenness of hashing.
HOT_ROWS = 4096


def _half(x: pa.Array, n: int) -> np.ndarray:
    """Vectors: each is a power of two and components of 1 at most."""
    if not n:
        return np.zeros((0, 0), np.float32)
    flat = np.frombuffer(b"".join(x.to_pylist()), np.int16).reshape(n, -1)
    return np.ldexp(flat[:, 1:].view(np.float16).astype(np.float32), flat[:, :1].astype(np.int32))


def points(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(p, ids: array<long>, v: array<double>, h: binary): a point for each different vector; p is its smallest id.

    h is scaled so that the largest component of all vectors is 1 at most; that changes no order of products.
    """
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    used = rows.where(good).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    used = used.groupBy("id").agg(F.min("v").alias("v"))
    sizes = used.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("largest")).orderBy(F.desc("count"), "n").first()
    most = int(np.frexp(sizes.largest)[1]) if sizes else 0
    used = used.where(F.size("v") == (sizes.n if sizes else 0)).withColumn("v", F.transform("v", lambda x: x + 0.0))
    kept = top + 1
    part = used.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, kept).alias("ids"))
    whole = part.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, kept).alias("ids"))

    def make():
        def run(batch):
            v = column(batch, "v").flatten().to_numpy().reshape(batch.num_rows, -1)
            power = np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]
            flat = np.concatenate([(power - most).astype(np.int16), np.ldexp(v, -power).astype(np.float16).view(np.int16)], axis=1)
            ids = column(batch, "ids")
            return {"p": pa.array([x[0].as_py() for x in ids], pa.int64()), "ids": ids, "v": column(batch, "v"), "h": pa.array([x.tobytes() for x in flat], pa.binary())}

        return run

    return by_batch(whole, ["v", "ids"], make, "p long, ids array<long>, v array<double>, h binary")


class Index:
    """Points and lists: points (p, ids, v, h), graph (p, near: array<long>, score: array<float>)."""

    def __init__(self, points: DataFrame, graph: DataFrame, buckets: int):
        self.points, self.graph, self.buckets = points, graph, buckets


def _bucket(name: str, buckets: int):
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def _best(p: np.ndarray, q: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best different q of each p; of equal pairs, one that isn't fresh stays."""
    order = np.lexsort((fresh, q, p))
    p, q, s, fresh = p[order], q[order], s[order], fresh[order]
    one = np.ones(len(p), bool)
    one[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    p, q, s, fresh = p[one], q[one], s[one], fresh[one]
    order = np.lexsort((q, -s, p))
    p, q, s, fresh = p[order], q[order], s[order], fresh[order]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, int)
    rank = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
    top = rank < k
    return p[top], q[top], s[top], fresh[top]


_GRAPH = "p long, near array<long>, score array<float>, fresh array<boolean>, changed int"


def _as_graph(p, q, s, fresh) -> pa.Table:
    nodes, n = np.unique(p, return_counts=True)
    new = np.add.reduceat(fresh.astype(np.int32), np.cumsum(n) - n) if len(p) else np.zeros(0, np.int32)
    return pa.table({"p": nodes, "near": lists(q, n, pa.int64()), "score": lists(s.astype(np.float32), n, pa.float32()), "fresh": lists(fresh.astype(bool), n, pa.bool_()), "changed": new.astype(np.int32)})


def _pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t["p"].to_numpy(), t["q"].to_numpy(), t["s"].to_numpy().astype(np.float32)


def _start(spark: SparkSession, pts: DataFrame, n: int, buckets: int, k: int, seed: int) -> DataFrame:
    """(p, q, s): exact neighbours within groups of agreeing signs; oversized groups are dealt out by hash.

    One more grouping is by hash alone, so that points without company in their cells get neighbours too.
    """
    width = len(pts.select("v").first().v)
    bits = max(0, int(np.ceil(np.log2(max(1, n / GROUP)))))
    directions = np.random.default_rng(seed).standard_normal((STARTS, bits, width)).astype(np.float32)

    def make_keys():
        def run(batch):
            x = _half(column(batch, "h"), batch.num_rows)
            signs = np.einsum("gbw,nw->gnb", directions, x) > 0
            keys = (signs @ (1 << np.arange(bits)).astype(np.int64)).reshape(STARTS, -1)
            dealt = (mixed(column(batch, "p").to_numpy()) % np.uint64(max(1, n // GROUP))).astype(np.int64)
            keys = np.concatenate([keys.ravel(), dealt])
            return {"p": pa.concat_arrays([column(batch, "p")] * (STARTS + 1)), "h": pa.concat_arrays([column(batch, "h")] * (STARTS + 1)), "g": np.repeat(np.arange(STARTS + 1, dtype=np.int64), batch.num_rows) << 40 | keys}

        return run

    keyed, path = saved(spark, by_batch(pts, ["p", "h"], make_keys, "p long, h binary, g long"), "groups")
    freed(spark)
    parts = keyed.groupBy("g").count().select("g", F.ceil(F.col("count") / (2 * GROUP)).alias("parts"))
    dealt = keyed.join(parts, "g").select("p", "h", F.xxhash64("g", F.pmod(F.xxhash64("p"), F.col("parts"))).alias("g"))

    def near(t: pa.Table) -> pa.Table:
        x, p = _half(t["h"], t.num_rows), t["p"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(p) - 1)
        at = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.zeros((len(p), 0), int)
        return pa.table({"p": np.repeat(p, m), "q": p[at].ravel(), "s": np.take_along_axis(s, at, 1).ravel().astype(np.float32)})

    return dealt.groupBy("g").applyInArrow(near, "p long, q long, s float")


def build(spark: SparkSession, pts: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 1) -> Index:
    """The index of some points."""
    importable(spark)
    pts, _ = saved(spark, pts, "points")
    freed(spark)
    n = pts.count()
    buckets = max(1, -(-n // BUCKET))
    if not n:
        return Index(pts, spark.createDataFrame([], _GRAPH), buckets)

    def merged(old: pa.Table, new: pa.Table) -> pa.Table:
        p, q, s = _pairs(new)
        fresh = np.ones(len(p), bool)
        if old.num_rows:
            near, score, was = (old[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("near", "score", "fresh"))
            lens = old["near"].combine_chunks().value_lengths().to_numpy()
            p, q, s = np.concatenate([np.repeat(old["p"].to_numpy(), lens), p]), np.concatenate([near, q]), np.concatenate([score, s])
            fresh = np.concatenate([np.zeros(len(near), bool), fresh])
        return _as_graph(*_best(p, q, s, fresh, k))

    def update(graph: DataFrame, new: DataFrame) -> tuple[DataFrame, str]:
        left, right = graph.groupBy(_bucket("p", buckets).alias("b")), new.groupBy(_bucket("p", buckets).alias("b"))
        out = saved(spark, left.cogroup(right).applyInArrow(merged, _GRAPH), "graph")
        freed(spark)
        return out

    graph, path = update(spark.createDataFrame([], _GRAPH), _start(spark, pts, n, buckets, k, seed))
    if n > 1 and graph.count() != n:
        raise RuntimeError("points without neighbours at the start")
    for turn in range(rounds):
        links = graph.select("p", F.element_at("score", -1).alias("least"), F.explode(F.arrays_zip("near", "fresh")).alias("x")).select("p", "least", F.col("x.near").alias("q"), F.col("x.fresh").alias("fresh"))
        forward = links.select(F.col("p").alias("at"), F.col("q").alias("p"), "fresh")
        backward = links.select(F.col("q").alias("at"), "p", "fresh").withColumn("r", F.expr(f"row_number() over (partition by at order by xxhash64(at, p, {turn}))")).where(F.col("r") <= REVERSE).drop("r")
        own = pts.select(F.col("p").alias("at"), "p", F.lit(True).alias("fresh"))
        members = forward.unionByName(backward).unionByName(own).groupBy("at", "p").agg(F.max("fresh").alias("fresh"))
        worst = graph.select("p", F.when(F.size("score") < k, F.lit(float("-inf"))).otherwise(F.element_at("score", -1)).cast("float").alias("least"))
        with_vectors = members.join(pts.select("p", "h").join(worst, "p", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")).cast("float"))), "p")
        new = with_vectors.groupBy(_bucket("at", buckets).alias("b")).applyInArrow(_meet, "p long, q long, s float")
        after, new_path = update(graph, new)
        dropped(spark, path)
        graph, path = after, new_path
        if graph.agg(F.sum("changed")).first()[0] <= LEAST_CHANGE * n * k:
            break
    return Index(pts, graph, buckets)


def _meet(t: pa.Table) -> pa.Table:
    """For each place, the pairs of those that meet there and are nearer than the first one's worst."""
    at, p, fresh, least = (t[c].to_numpy(zero_copy_only=False) for c in ("at", "p", "fresh", "least"))
    x = _half(t["h"], t.num_rows)
    order = np.argsort(at, kind="stable")
    ends = np.append(np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0])), len(at))
    out: list[tuple] = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        i = order[a:b]
        s = x[i] @ x[i].T
        s[(s <= least[i][:, None]) | ~(fresh[i][:, None] | fresh[i][None, :]) | np.eye(len(i), dtype=bool)] = -np.inf
        m = min(TAKEN, len(i))
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        found = np.take_along_axis(s, best, 1)
        r, c = np.nonzero(found > -np.inf)
        out.append((p[i[r]], p[i[best[r, c]]], found[r, c]))
    u, v, s = (np.concatenate(z) for z in zip(*out, strict=True))
    # one meeting place of many gives the same pair: keep one of each before the shuffle
    order = np.lexsort((v, u))
    one = np.concatenate([[True], (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)]) if len(u) else np.zeros(0, bool)
    i = order[one]
    return pa.table({"p": u[i], "q": v[i], "s": s[i].astype(np.float32)})


_STATE = "q long, h binary, near array<long>, score array<float>, open array<boolean>"


def search(spark: SparkSession, index: Index, queries: DataFrame, top: int = TOP, beam: int = BEAM, opened: int = OPENED) -> DataFrame:
    """(q, near: array<long>): the beam of each query (q: a point of the index)."""
    b = index.buckets
    lists_ = index.graph.select("p", F.explode("near").alias("n")).join(index.points.select(F.col("p").alias("n"), "h"), "n")
    lists_, lists_path = saved(spark, lists_.groupBy("p").agg(F.collect_list("n").alias("near"), F.collect_list("h").alias("hs")), "lists")
    freed(spark)
    state = queries.select("q").distinct().join(index.points.select(F.col("p").alias("q"), "h"), "q")
    state = state.select("q", "h", F.array("q").alias("near"), F.array(F.lit(float("inf")).cast("float")).alias("score"), F.array(F.lit(False)).alias("open"))
    state, path = saved(spark, state, "state")

    def meet(frontier: pa.Table, lists_: pa.Table) -> pa.Table:
        row = {x: k for k, x in enumerate(zip(lists_["p"].to_pylist(), lists_["part"].to_pylist(), strict=True))} if frontier.num_rows else {}
        if not row:
            return pa.table({"q": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "s": pa.array([], pa.float32())})
        q, p, part, least = (frontier[c].to_numpy() for c in ("q", "p", "part", "least"))
        x = _half(frontier["h"], frontier.num_rows)
        near, hs = lists_["near"].combine_chunks(), lists_["hs"].combine_chunks()
        order = np.lexsort((part, p))
        ends = np.append(np.flatnonzero(np.concatenate([[True], (np.diff(p[order]) != 0) | (np.diff(part[order]) != 0)])), len(p))
        out = []
        for a, c in zip(ends[:-1], ends[1:], strict=True):
            k = row.get((int(p[order[a]]), int(part[order[a]])))
            if k is not None:
                i, n = order[a:c], near[k].values.to_numpy()
                s = x[i] @ _half(hs[k].values, len(n)).T
                r, j = np.nonzero((s > least[i][:, None]) & (n[None, :] != q[i][:, None]))
                out.append((q[i[r]], n[j], s[r, j]))
        u, v, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return pa.table({"q": u, "n": v, "s": s.astype(np.float32)})

    def advance(state: pa.Table, found: pa.Table) -> pa.Table:
        lens = state["near"].combine_chunks().value_lengths().to_numpy()
        near, score, was = (state[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("near", "score", "open"))
        q = np.repeat(state["q"].to_numpy(), lens)
        # what has been in the frontier is open now
        rank = np.arange(len(q)) - np.repeat(np.cumsum(lens) - lens, lens)
        closed = ~was
        nth = np.cumsum(closed) - np.repeat((np.cumsum(closed) - closed)[np.cumsum(lens) - lens], lens)
        was = was | (closed & (nth <= opened))
        fresh = np.concatenate([~was, np.ones(found.num_rows, bool)])
        del rank
        p, n, s, closed = _best(np.concatenate([q, found["q"].to_numpy()]), np.concatenate([near, found["n"].to_numpy()]), np.concatenate([score, found["s"].to_numpy()]), fresh, beam + 1)
        ids, n_of = np.unique(p, return_counts=True)
        h = dict(zip(state["q"].to_pylist(), state["h"].to_pylist(), strict=True))
        return pa.table({"q": ids, "h": pa.array([h[i] for i in ids.tolist()], pa.binary()), "near": lists(n, n_of, pa.int64()), "score": lists(s.astype(np.float32), n_of, pa.float32()), "open": lists(~closed.astype(bool), n_of, pa.bool_())})

    importable(spark)
    crowded = state.count() > HOT_ROWS  # no more queries open a list than there are
    while True:
        waiting = F.filter(F.arrays_zip("near", "open"), lambda x: ~x["open"])
        full = F.when(F.size("near") > beam, F.element_at("score", -1)).otherwise(F.lit(float("-inf"))).cast("float")
        frontier = state.select("q", "h", full.alias("least"), F.explode(F.slice(waiting, 1, opened)).alias("x")).select("q", "h", "least", F.col("x.near").alias("p"))
        if frontier.isEmpty():
            break
        # by inner product the largest vectors are in nearly every list: many queries open the same points at once
        ours, theirs, used = frontier.withColumn("part", F.lit(0).cast("long")), lists_.withColumn("part", F.lit(0).cast("long")), [path]
        if crowded:
            hot, hot_path = saved(spark, frontier.groupBy("p").count().where(F.col("count") > HOT_ROWS).select("p", F.ceil(F.col("count") / HOT_ROWS).alias("parts")), "hot")
            used.append(hot_path)
            if n_hot := hot.count():
                hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
                ours = frontier.join(hot, "p", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("q"), "parts"), F.lit(0))).drop("parts")
                theirs = lists_.join(hot, "p", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        bucket = F.when(F.col("part") == 0, _bucket("p", b)).otherwise(F.pmod(F.xxhash64("p", "part"), F.lit(b))).alias("b")
        found = ours.groupBy(bucket).cogroup(theirs.groupBy(bucket)).applyInArrow(meet, "q long, n long, s float")
        after = state.groupBy(_bucket("q", b).alias("b")).cogroup(found.groupBy(_bucket("q", b).alias("b"))).applyInArrow(advance, _STATE)
        after, new_path = saved(spark, after, "state")
        dropped(spark, *used)
        freed(spark)
        state, path = after, new_path
    dropped(spark, lists_path)
    return state.select("q", "near")


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, **options) -> DataFrame:
    """(query_id, rank, key, score): the ``top`` nearest rows found of each row whose id is in ``queries`` (key)."""
    spark = rows.sparkSession
    index = build(spark, points(rows, key, vector, top), **options)
    copies = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = copies.groupBy("id").agg(F.min("v").alias("v")).withColumn("v", F.transform("v", lambda x: x + 0.0))
    asked, _ = saved(spark, asked.join(index.points.select("p", "v"), "v").select("id", F.col("p").alias("q")), "asked")
    freed(spark)
    beams = search(spark, index, asked.select("q"), top)
    pairs = beams.select("q", F.explode("near").alias("p"))
    own = index.points.select(F.col("p").alias("q"), F.col("v").alias("w"))
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    exact = pairs.join(index.points.select("p", "ids", "v"), "p").join(own, "q").select("q", "ids", product.alias("s"))

    def first(t: pa.Table) -> pa.Table:
        ids, n = t["ids"].combine_chunks().flatten().to_numpy(), t["ids"].combine_chunks().value_lengths().to_numpy()
        q, s = np.repeat(t["q"].to_numpy(), n), np.repeat(t["s"].to_numpy(), n)
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        best = rank <= top  # one more, for the query's own row
        return pa.table({"q": q[best], "id": ids[best], "s": s[best]})

    answers = exact.groupBy(_bucket("q", index.buckets).alias("b")).applyInArrow(first, "q long, id long, s double")
    answers = answers.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), "id", "s"))).alias("all"))
    mine = asked.join(answers, "q").select(F.col("id").alias("query_id"), F.slice(F.filter("all", lambda x: x["id"] != F.col("id")), 1, top).alias("all"))
    return mine.select("query_id", F.posexplode("all").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), F.col("x.s").alias("score"))
