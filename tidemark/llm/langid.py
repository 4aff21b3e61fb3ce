"""Language identification by words, backing off to characters (operator 4).

A known word adds its log frequency in each language. An unseen word is scored by the longest character
n-grams of it (with its ends marked) that are known: those of five characters, else of four, and so on
down to single characters; their mean log frequencies stand for the word. A word of which nothing is known
adds nothing. The predicted language has the largest sum, ties go to the name that sorts first; the score
is its posterior under equal priors.

Fitting takes a bounded sample of labelled rows: about ``FIT_DOCS`` of each language, chosen by hash, and
keeps the most frequent words and n-grams of each length, ``MOST_WORDS`` and ``MOST_GRAMS`` at most (those as
frequent as one another go together). Every language of
the labels is learned; the model takes four bytes for each of them and each entry. It is broadcast once,
and each task keeps the rows of words it has met. Prediction reads every document and its
whole text.

Defined results: a letter is what Unicode calls one (``\\p{L}``: neither digits nor fractions nor marks);
a null text and one without a letter give ``und`` with score 0, as does everything when no labelled row
exists; a null language isn't a label; rows with a null key aren't learned from; repeated rows get equal
results; an empty table gives an empty one; other columns of the input play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, by_batch, column, dropped, importable, looked_up, saved, texts

#: Labelled documents of each language to learn from; words and n-grams (of each length) that a model holds at most.
FIT_DOCS, MOST_WORDS, MOST_GRAMS = 3_000, 60_000, 30_000
ORDERS, SMOOTHING = (5, 4, 3, 2, 1), 0.5
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")  # letters, and numbers that aren't digits, as in "½" or "Ⅷ"
#: Words that are scored together; different words that a task keeps.
_TOGETHER, _MOST = 1 << 17, 150_000


def letters(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    found = _WORD.findall(text.lower()) if text else []
    if not found or "".join(found).isalpha():
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word with marked ends; for n = 1, its characters."""
    if n > 1:
        word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Log frequencies by word and by n-gram: one row of ``table`` (float32) for each key of ``rows``."""

    def __init__(self, languages: list[str], rows: dict[str, int], table: np.ndarray):
        self.languages, self.rows, self.table = languages, rows, table

    def word(self, word: str) -> np.ndarray:
        row = self.rows.get(f" {word}")
        if row is not None:
            return self.table[row]
        for n in ORDERS:
            found = [r for r in map(self.rows.get, grams(word, n)) if r is not None]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(len(self.languages))

    def result(self, sums: np.ndarray) -> tuple[str, float]:
        best = int(np.argmax(sums))
        return self.languages[best], float(1 / np.exp(sums - sums[best]).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """One text, word by word; Spark's workers do the same with a cache."""
        found = letters(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        return self.result(np.sum([self.word(w) for w in found], axis=0, dtype=float))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """A model from (key, text, lang) rows; give it only those that may be learned from."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], {}, np.zeros((0, 0), np.float32))
    shares = spark.createDataFrame([(r["lang"], i, int(min(1.0, fit_docs / r["count"]) * (1 << 30))) for i, r in enumerate(sizes)], "lang string, l int, below long")
    sample = rows.join(F.broadcast(shares), "lang").where(F.col("k").isNotNull() & (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.col("below")))

    def make():
        def run(batch):
            counts = Counter()
            for t, x in zip(texts(batch), column(batch, "l").to_pylist(), strict=True):
                for w, c in Counter(letters(t)).items():
                    counts[x, 0, f" {w}"] += c
                    for n in ORDERS:
                        for g in grams(w, n):
                            counts[x, n, g] += c
            x, n, g = zip(*counts, strict=True) if counts else ((), (), ())
            return {"l": np.array(x, np.int32), "n": np.array(n, np.int32), "g": list(g), "c": np.fromiter(counts.values(), np.int64, len(counts))}

        return run

    counts = by_batch(sample, ["text", "l"], make, "l int, n int, g string, c long").groupBy("n", "g").pivot("l", list(range(len(languages)))).agg(F.sum("c"))
    counts = counts.select("n", "g", F.array(*[F.coalesce(F.col(str(i)), F.lit(0)) for i in range(len(languages))]).alias("c"))
    counts, path = saved(spark, counts.withColumn("all", F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + b)), "grams")
    totals = {r.n: np.array(r.c, float) for r in counts.groupBy("n").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(len(languages))]).alias("c")).collect()}
    # how many entries of each length there are from each of at most a thousand counts on: all that are as frequent are in or out
    sizes = counts.groupBy("n", F.floor(16 * F.log2("all")).alias("b")).agg(F.min("all").alias("least"), F.count("*").alias("size")).orderBy("n", F.desc("b")).collect()
    least, so_far = {}, Counter()
    for r in sizes:
        so_far[r.n] += r.size
        if so_far[r.n] <= (MOST_GRAMS if r.n else MOST_WORDS):
            least[r.n] = r.least
    kept = F.lit(False)
    for n, c in least.items():
        kept = kept | ((F.col("n") == n) & (F.col("all") >= c))
    top = counts.where(kept).select("n", "g", "c").toArrow()
    n = top["n"].to_numpy()
    table = top["c"].combine_chunks().flatten().to_numpy().reshape(len(n), -1).astype(np.float32) if len(n) else np.zeros((0, len(languages)), np.float32)
    for order, total in totals.items():
        own = n == order
        table[own] = np.log((table[own] + SMOOTHING) / (total + SMOOTHING * (own.sum() + 1)))
    dropped(spark, path)
    return Model(languages, {g: i for i, g in enumerate(top["g"].to_pylist())}, table)


class _Known:
    """A model with the rows of words that were met."""

    def __init__(self, model: Model):
        self.model, self.table = model, np.zeros((1024, len(model.languages)), np.float32)
        self.rows = Cache(self._put, _MOST)

    def _put(self, word: str) -> int:
        if len(self.rows) + 1 > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[len(self.rows)] = self.model.word(word)
        return len(self.rows)

    def results(self, found: list[str | None]) -> tuple[list[str], list[float]]:
        model, names, scores = self.model, [UNKNOWN] * len(found), [0.0] * len(found)
        at, flat, ends = [], [], []

        def give():
            if flat:
                rows = looked_up(self.rows, flat)
                doc = np.repeat(np.arange(len(at)), np.diff(ends, prepend=0))
                sums = np.stack([np.bincount(doc, self.table[rows, x], len(at)) for x in range(len(model.languages))], axis=1)
                best = sums.argmax(axis=1)
                score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, s in zip(at, best.tolist(), score.tolist(), strict=True):
                    names[i], scores[i] = model.languages[b], s
            at.clear(), flat.clear(), ends.clear()
            self.rows.trim()

        for i, text in enumerate(found):
            words = letters(text) if model.languages else []
            if words:
                at.append(i)
                flat.extend(words)
                ends.append(len(flat))
                if len(flat) >= _TOGETHER:
                    give()
        give()
        return names, scores


def predicted(text: Column, model: Model, spark: SparkSession | None = None) -> Column:
    """struct<lang_pred: string, score: double> of each text."""
    shared = (spark or SparkSession.active()).sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(shared.value)
        for part in columns:
            names, scores = known.results(part.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run(text)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    spark = docs.sparkSession
    importable(spark)
    return docs.select(key, predicted(F.col(text), model, spark).alias("_found")).select(key, "_found.lang_pred", "_found.score")
