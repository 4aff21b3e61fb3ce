"""Mixing sources to target weights with soft membership (operator 9).

A classifier learned from a labelled table gives every document posteriors over the domains. Fitted are
nonnegative rates r whose expected token totals, the sum over documents of rate * tokens * posterior, match
the targets: least squares in the totals by projected gradient from r = 1. Each step goes against the
gradient, which for a document is its posterior times the totals' errors, and sets what would be negative
to zero. It is scaled by the inverse of the totals' second derivatives over the documents whose rates are
positive, and rates at zero that the gradient holds there stay (the two-metric projection, which keeps the
step one of descent). Several lengths of the step are tried in one pass and the best is taken; where none is
nearer to the targets, the plain gradient is tried; where that isn't either, the rates are the nearest in
least squares. A warning tells targets that can't be met, and the totals reached are columns of the result.

A document's rate is a function of its posteriors and the steps so far. Hence no rates are stored between
steps: each is one aggregation over the posteriors' table, to a few numbers for each length tried, and loses
nothing with an executor.

The classifier is a softmax regression over hashed words, fitted in numpy on at most ``FIT_DOCS`` labelled
documents of each domain, chosen by hash. Posteriors and totals cover every document and its whole text.

Defined results: a null or empty text has no tokens, the class priors as posteriors and counts nothing;
without labelled documents in the table all domains are equally likely; the target of a domain nobody
belongs to can't be met; of a document's different labels the one that sorts first holds; repeated rows each
count; an empty table gives an empty one; other columns of the input play no part.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, column, dropped, hash_cache, lists, looked_up, mixed, saved, texts, words

FIT_DOCS, BUCKETS, SEED = 4_000, 1 << 14, 9
#: Of the regression: steps of Adam, their size, and the weight of the squared norm.
STEPS, RATE, DECAY = 60, 0.05, 1e-4
#: Of the rates: the largest error of a total (in shares of all tokens) at which steps end, that without a warning, the least part by which a step must lessen the squared error, and the most steps.
TOLERANCE, UNMET, LEAST_GAIN, MOST_STEPS = 1e-10, 1e-6, 1e-7, 500
#: Parts of a step that are tried at once; rows of a partition of the posteriors' table.
_PARTS, _ROWS = 2.0 ** -np.arange(12), 1 << 17


def hashed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word hashes and their weights, of Euclidean norm 1."""
    found, n = np.unique((mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int32), return_counts=True)
    value = np.log1p(n).astype(np.float32)
    return found, value / (np.linalg.norm(value) or 1)


class Classifier:
    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posteriors(self, h: np.ndarray) -> np.ndarray:
        x = self.bias.copy()
        if len(h):
            at, value = hashed(h)
            x += value @ self.weights[at]
        x = np.exp(x - x.max())
        return x / x.sum()


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> Classifier:
    """labelled: (key, domain); rows of other domains than ``domains`` are not used."""
    one = labelled.where(F.col(key).isNotNull() & F.col("domain").isin(domains)).groupBy(F.col(key).cast("long").alias("k")).agg(F.min("domain").alias("domain"))
    chosen = [r for d in domains for r in one.where(F.col("domain") == d).orderBy(F.xxhash64("k"), "k").limit(fit_docs).collect()]
    k = len(domains)
    if not chosen:
        return Classifier(domains, np.zeros((BUCKETS, k)), np.zeros(k))
    ids = docs.sparkSession.createDataFrame([(int(r.k), domains.index(r.domain)) for r in chosen], "k long, y int")
    sample = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).join(F.broadcast(ids), "k")

    def make():
        cache = hash_cache(SEED)

        def run(batch):
            found = [hashed(looked_up(cache, words(x))) for x in texts(batch)]
            n = np.array([len(a) for a, _ in found], np.int64)
            return {"y": column(batch, "y"), "at": lists(np.concatenate([a for a, _ in found]), n, pa.int32()), "v": lists(np.concatenate([v for _, v in found]), n, pa.float32())}

        return run

    rows = by_batch(sample, ["text", "y"], make, "y int, at array<int>, v array<float>").toArrow().combine_chunks()
    if not rows.num_rows:  # none of the labelled documents is in the table
        return Classifier(domains, np.zeros((BUCKETS, k)), np.zeros(k))
    y, at, v = rows["y"].to_numpy(), rows["at"].combine_chunks(), rows["v"].combine_chunks()
    doc = np.repeat(np.arange(len(y)), at.value_lengths().to_numpy())
    at, v = at.flatten().to_numpy(), v.flatten().to_numpy().astype(np.float64)
    hot = np.eye(k)[y]
    p = np.concatenate([np.zeros(BUCKETS * k), np.log((hot.sum(axis=0) + 1) / (len(y) + k))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        w, b = p[: BUCKETS * k].reshape(BUCKETS, k), p[BUCKETS * k :]
        x = np.stack([np.bincount(doc, v * w[at, d], len(y)) for d in range(k)], axis=1) + b
        x = np.exp(x - x.max(axis=1, keepdims=True))
        e = (x / x.sum(axis=1, keepdims=True) - hot) / len(y)
        g = np.concatenate([np.stack([np.bincount(at, v * e[doc, d], BUCKETS) for d in range(k)], axis=1).ravel() + DECAY * w.ravel() / len(y), e.sum(axis=0)])
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        p = p - RATE * 10 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Classifier(domains, p[: BUCKETS * k].reshape(BUCKETS, k).copy(), p[BUCKETS * k :].copy())


def memberships(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens: long, posteriors: array<double> in the order of the model's domains); tokens are words."""

    def make():
        cache = hash_cache(SEED)

        def run(batch):
            n, p = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(model.domains)))
            for i, x in enumerate(texts(batch)):  # one text's words at a time
                h = looked_up(cache, words(x))
                n[i], p[i] = len(h), model.posteriors(h)
            cache.trim()
            return {key: column(batch, key), "n_tokens": n, "posteriors": lists(p.ravel(), np.full(len(n), p.shape[1]), pa.float64())}

        return run

    return by_batch(docs, [F.col(key).cast("long").alias(key), F.col(text).alias("text")], make, f"{key} long, n_tokens long, posteriors array<double>")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return column(batch, "n_tokens").to_numpy().astype(float), column(batch, "posteriors").flatten().to_numpy().reshape(batch.num_rows, -1)


def rates_of(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each document's rate after the steps (steps, 2, domains): the totals' errors and what they move rates by, both times the posterior."""
    r = np.ones(len(p))
    for error, move in steps:
        held = (r == 0) & (p @ error >= 0)
        r = np.maximum(0.0, r - p @ move)
        r[held] = 0.0
    return r


def fit_rates(soft: DataFrame, targets: list[float], total: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What rates_of() takes, the totals reached and those aimed at; targets are shares of ``total`` (all tokens unless given)."""
    k = len(targets)
    size = k + k * k

    def tried(steps: np.ndarray, moves: np.ndarray, error: np.ndarray) -> np.ndarray:
        """After each of the moves: the totals, and their second derivatives over the positive rates."""

        def make():
            def run(batch):
                n, p = _matrix(batch)
                before, found = rates_of(p, steps), []
                held = (before == 0) & (p @ error >= 0)
                for move in moves:
                    r = np.maximum(0.0, before - p @ move)
                    r[held] = 0.0
                    found += [(n * r) @ p, (p.T @ ((n * (r > 0))[:, None] * p)).ravel()]
                return {"i": np.arange(len(moves) * size), "x": np.concatenate(found)}

            return run

        rows = by_batch(soft, ["n_tokens", "posteriors"], make, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(moves) * size)
        out[[r.i for r in rows]] = [r.x for r in rows]
        return out.reshape(-1, size)

    none, steps = np.zeros(k), np.zeros((0, 2, k))
    at = tried(steps, none[None], none)[0]
    tokens = at[:k].sum()
    aim = np.array(targets, float) / (sum(targets) or 1) * (tokens if total is None else total)
    longest = np.linalg.eigvalsh(at[k:].reshape(k, k) / (tokens or 1)).max()  # what the gradient can grow by
    while tokens and len(steps) < MOST_STEPS:
        error = (at[:k] - aim) / tokens
        if np.abs(error).max() <= TOLERANCE:
            break
        second = at[k:].reshape(k, k) / tokens
        scaled = np.linalg.solve(second + 1e-12 * max(longest, 1e-300) * np.eye(k), error)
        for move in (scaled, error / longest):
            moves = _PARTS[:, None] * move
            found = tried(steps, moves, error)
            squared = (((found[:, :k] - aim) / tokens) ** 2).sum(axis=1)
            best = int(np.argmin(squared))
            if squared[best] < (error**2).sum() * (1 - LEAST_GAIN):
                steps, at = np.concatenate([steps, np.stack([error, moves[best]])[None]]), found[best]
                break
        else:  # nothing is nearer
            break
    reached = at[:k]
    if np.abs(reached - aim).max() > UNMET * max(1.0, aim.sum()):
        warnings.warn(f"no rates meet the targets: totals {reached.tolist()}, targets {aim.tolist()}", stacklevel=2)
    return steps, reached, aim


def rated(soft: DataFrame, steps: np.ndarray, key: str = "doc_id") -> DataFrame:
    """soft with ``rate``."""

    def make():
        return lambda b: {c: column(b, c) for c in (key, "n_tokens", "posteriors")} | {"rate": rates_of(_matrix(b)[1], steps)}

    return by_batch(soft, [key, "n_tokens", "posteriors"], make, f"{key} long, n_tokens long, posteriors array<double>, rate double")


def mixed_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, posteriors, rate, reached, aimed) of every document; the last two are the totals, alike in every row."""
    spark = docs.sparkSession
    model = fit_classifier(docs, labelled, sorted(targets), key, text)
    soft, _ = saved(spark, memberships(docs, model, key, text), "soft")
    few, path = saved(spark, soft.select("n_tokens", "posteriors").coalesce(max(1, -(-soft.count() // _ROWS))), "few")  # few tasks for each of many steps
    steps, reached, aim = fit_rates(few, [targets[x] for x in model.domains])
    dropped(spark, path)
    totals = [F.array(*[F.lit(float(x)) for x in values]).alias(name) for name, values in (("reached", reached), ("aimed", aim))]
    return rated(soft, steps, key).select("*", *totals)


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """How often a document is taken: its rate rounded down or up by a draw that depends on its key alone."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.coalesce(rate, F.lit(1.0)) + draw).cast("int")


def domains_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, domain) from quality and toxicity labels: toxic, else good or low."""
    return labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select(key, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("low").alias("domain"))
