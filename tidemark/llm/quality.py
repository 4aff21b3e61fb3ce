"""Quality rules by a hashed n-gram likelihood ratio (operator 8).

Words and pairs of words are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are
counted: one over trusted target documents, one over the raw corpus, which is every document. A
document's score is the mean log-likelihood ratio of its n-grams, so length doesn't count; it is kept
where the score is at least a fixed threshold and no base rule failed. Nothing is drawn at random.

The counts cover every document and its whole text; each task adds up its own documents before the
shuffle, and the driver gets one row for each bucket. The trusted documents are all that are labelled with
good quality; their ids are broadcast only if they were counted to be few, else documents are joined to them.

Defined results: a null or empty text has no words, no score and fails the base rules; without trusted
documents every score is 0; a label for which several rows differ counts as the higher; repeated rows get
equal results; other columns of the input play no part. Windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, by_batch, column, hash_cache, importable, looked_up, mixed, texts, words

BUCKETS, SMOOTHING, SEED = 1 << 20, 0.5, 8
#: The least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.1
#: The base rules: fewest words, and the largest share of words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3

# Fixed values.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


def ngrams(h: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours among word hashes."""
    u = h.view(np.uint64)
    both = np.concatenate([u, u[:-1] * np.uint64(0x9E3779B97F4A7C15) + u[1:] + np.uint64(1)])
    return (mixed(both) & np.uint64(BUCKETS - 1)).astype(np.int64)


def repeated(h: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    u = mixed(h.view(np.uint64))
    keys = u[:n].copy()
    for i in range(1, window):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + u[i : i + n])
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    covered = np.zeros(len(h) + 1, np.int64)
    starts = np.flatnonzero(times[place] > 1)
    covered[starts] += 1
    covered[: len(h)] = np.cumsum(covered[: len(h)])
    inside = covered[: len(h)].copy()
    inside[window:] -= covered[: len(h) - window]
    return int(np.count_nonzero(inside))


def lines_again(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    found = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(found) - len(set(found))


def counts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Counts by bucket of the raw corpus (row 0) and of the trusted documents (row 1)."""
    ids = trusted.select(F.col(key).alias("k"), F.lit(1).alias("t"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    marked = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).join(ids, "k", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = hash_cache(SEED), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for x, t in zip(texts(batch), column(batch, "t").to_pylist(), strict=True):
                if w := words(x):
                    at = ngrams(looked_up(cache, w))
                    for row in (0, 1)[: 1 + bool(t)]:
                        np.add.at(total[row], at, 1)
            cache.trim()
        full = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[0][full]), pa.array(total[1][full])], names=["bucket", "raw", "target"])

    importable(docs.sparkSession)
    parts = marked.select("text", "t").mapInArrow(run, "bucket long, raw long, target long")
    found = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    total = np.zeros((2, BUCKETS), np.int64)
    for row, name in enumerate(("raw", "target")):
        total[row, found["bucket"].to_numpy()] = found[name].to_numpy()
    return total


def ratios(total: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of target to raw by bucket."""
    if not total[1].any():
        return np.zeros(BUCKETS)
    p = (total + SMOOTHING) / (total.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return (np.log(p[1]) - np.log(p[0])).astype(np.float32)


def trusted_of(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids of the documents labelled good."""
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.max(quality).alias("q"))
    return good.where("q = 1").select(key)


def judged(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row."""

    def make():
        cache = hash_cache(SEED)

        def one(x: str | None) -> tuple:
            x = x or ""
            w = words(x)
            h = looked_up(cache, w)
            again = repeated(h)
            failed = len(w) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(w)
            score = float(ratio[ngrams(h)].mean(dtype=np.float64)) if w else None
            chars = len(x) - sum(map(x.count, BLANKS))
            return len(w), chars, sum(map(x.count, SYMBOLS)), lines_again(x), again, failed, score, not failed and score >= threshold

        def run(batch):
            rows = [one(x) for x in texts(batch)]
            cache.trim()
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())
            return {key: column(batch, key)} | {n: pa.array(v, k) for n, v, k in zip(names, zip(*rows, strict=True), kinds, strict=True)}

        return run

    return by_batch(
        docs, [F.col(key).cast("long").alias(key), F.col(text).alias("text")], make,
        f"{key} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean",
    )


def rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The verdict of every row of ``docs``, with the good rows of ``labels`` as the target."""
    return judged(docs, ratios(counts(docs, trusted_of(labels, key), key, text)), key, text, threshold)
