"""Toxicity by a weighted lexicon (operator 6).

Texts are folded first: compatibility forms are undone, letters of other scripts that look Latin and
digits or signs that stand for letters become those letters, characters without width go, and every run
of other characters becomes one blank. The lexicon holds whole words and word beginnings with their log odds of occurring in
toxic rather than other documents; an Aho-Corasick automaton finds all of them in one pass. Where several
entries match at one word, the heaviest counts. A match inside an exception phrase (a pair of words of
which one matches, but which other documents use) counts nothing. The sum of weights is divided by the
text's length in words, and a logistic curve turns it into a score.

Lexicon, exceptions and curve are learned from a bounded sample of labelled rows: at most ``FIT_DOCS`` of
each label, chosen by hash. Scoring covers every document and its whole text.

Defined results: a null or empty text has no words and the score of a text without matches; null labels
don't count as labels; if a document's labels differ, the higher holds; without labelled rows the lexicon
is empty and every score 0; repeated rows get equal scores; other columns of the input play no part.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, column, dropped, saved, texts

#: Labelled rows of each label to learn from, entries of the lexicon, exception phrases.
FIT_DOCS, ENTRIES, EXCEPTIONS = 20_000, 2_000, 500
#: Lengths of word beginnings; log odds that an entry needs, and its least log-likelihood ratio statistic.
BEGINNINGS, LEAST_WEIGHT, LEAST_G2 = (4, 5, 6, 7, 8, 9), 1.5, 26.0
#: Words that a text counts as at least, so that one match in a few words isn't everything.
LEAST_WORDS = 50

# Letters that look Latin, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}

_TABLE = str.maketrans(LOOKALIKES)
_OTHER = re.compile(r"[\W\d_]+")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")


def folded(text: str | None) -> str:
    """Lower-case Latin words, one blank before and after each."""
    if not text:
        return " "
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    return f" {_OTHER.sub(' ', text.lower().translate(_TABLE)).strip()} "


def features(text: str | None) -> set[str]:
    """What a lexicon could hold of the text: words with a blank on both sides, beginnings with one before."""
    found = set()
    for w in set(folded(text).split()):
        if len(w) > 2:
            found.add(f" {w} ")
            found.update(f" {w[:k]}" for k in BEGINNINGS if len(w) >= k)
    return found


class Lexicon:
    """Weights of entries, exception phrases, and the curve's coefficients (constant, rate, sum)."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(), curve: tuple[float, float, float] = (-4.0, 20.0, 0.5)):
        self.weights, self.exceptions, self.curve = weights, frozenset(exceptions), curve
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        if weights:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve)

    def matches(self, text: str) -> dict[int, float]:
        """Start of each matching word in a folded text, and its heaviest entry's weight."""
        found: dict[int, float] = {}
        for end, (n, weight) in self.automaton.iter(text) if self.weights else ():
            start = end - n + 1
            if weight > found.get(start, 0.0):
                found[start] = weight
        return found

    def phrases(self, text: str, start: int) -> tuple[str, str]:
        """The matching word with the word before and with the word after."""
        end = text.index(" ", start + 1)
        before, after = text.rfind(" ", 0, start) if start else -1, text.find(" ", end + 1)
        return text[before + 1 : end] if start else "", text[start + 1 : after] if after > 0 else ""

    def sums(self, text: str | None) -> tuple[float, float]:
        """The sum of weights over the text's length in words, and its logarithm."""
        text = folded(text)
        found = self.matches(text)
        if found and self.exceptions:
            found = {s: w for s, w in found.items() if not self.exceptions.intersection(self.phrases(text, s))}
        total = sum(found.values())
        return total / max(LEAST_WORDS, text.count(" ") - 1), math.log1p(total)

    def score(self, text: str | None) -> float:
        rate, total = self.sums(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * rate + c * total)))) if self.weights else 0.0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS) -> Lexicon:
    """A lexicon from the labelled rows of ``docs``; labels: (key, label 0 or 1), rows to learn from only."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    ids = None
    for value in (0, 1):  # bounded: at most fit_docs each
        part = one.where(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(fit_docs)
        ids = part if ids is None else ids.unionByName(part)
    chosen = [(int(r[0]), int(r[1])) for r in ids.collect()]
    if not chosen:
        return Lexicon({})
    kept = docs.sparkSession.createDataFrame(chosen, f"{key} long, _label int")
    sample = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).join(F.broadcast(kept), key)
    # copies would make chance words look telling; the sample, which is bounded, is read several times
    sample, sample_path = saved(docs.sparkSession, sample.dropDuplicates(["text", "_label"]).select("text", "_label"), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}

    def counting(give):
        def make():
            def run(batch):
                n = [Counter(), Counter()]
                for x, y in zip(texts(batch), column(batch, "_label").to_pylist(), strict=True):
                    n[y].update(give(x))
                found = list(n[0].keys() | n[1].keys())
                return {"entry": pa.array(found, pa.string()), "other": np.array([n[0][w] for w in found], np.int64), "toxic": np.array([n[1][w] for w in found], np.int64)}

            return run

        counts = by_batch(sample, ["text", "_label"], make, "entry string, other long, toxic long")
        return counts.groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))

    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("other") + 0.5) / (n0 + 1.0))
    t, o = F.col("toxic"), F.col("other")
    share = n1 / max(1, n0 + n1)
    g2 = 2 * (F.when(t > 0, t * F.log(t / ((t + o) * share))).otherwise(0.0) + F.when(o > 0, o * F.log(o / ((t + o) * (1.0 - share)))).otherwise(0.0))
    found = counting(features).withColumn("w", weight).where((F.col("w") >= LEAST_WEIGHT) & (g2 >= LEAST_G2)) if n0 and n1 else kept.where("false").selectExpr("'' entry", "0D w")
    lexicon = Lexicon({r.entry: r.w for r in found.orderBy(F.desc("w"), "entry").limit(ENTRIES).collect()})

    def pairs(x):
        x = folded(x)
        return {p for s in lexicon.matches(x) for p in lexicon.phrases(x, s) if p}

    benign = counting(pairs).where(f"other >= 3 and other * {n1 + 1} > toxic * {n0 + 1}")
    lexicon = Lexicon(lexicon.weights, {r.entry for r in benign.orderBy(F.desc("other"), "entry").limit(EXCEPTIONS).collect()})

    def make_sums():
        return lambda b: dict(zip(("rate", "total"), np.array([lexicon.sums(x) for x in texts(b)]).T, strict=True)) | {"_label": column(b, "_label")}

    rows = by_batch(sample, ["text", "_label"], make_sums, "rate double, total double, _label int").collect()
    dropped(docs.sparkSession, sample_path)
    return Lexicon(lexicon.weights, lexicon.exceptions, _curve(np.array([[1.0, r[0], r[1]] for r in rows]), np.array([r[2] for r in rows], float)))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; coefficients of rate and sum aren't negative."""
    free = [0, 1, 2]
    while True:
        b = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            xs = x[:, free]
            step = np.linalg.solve(xs.T @ (xs * (p * (1 - p))[:, None]) + ridge * np.eye(len(free)), xs.T @ (y - p) - ridge * b[free])
            b[free] += step
            if np.abs(step).max() < 1e-9:
                break
        bad = [k for k in (1, 2) if k in free and b[k] < 0]
        if not bad:
            return tuple(float(v) for v in b)
        free = [k for k in free if k not in bad]


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""

    def make():
        return lambda b: {key: column(b, key), "score": np.array([lexicon.score(x) for x in texts(b)], np.float64)}

    return by_batch(docs, [F.col(key).cast("long").alias(key), F.col(text).alias("text")], make, f"{key} long, score double")
