"""Language-model scoring of complete documents (operator 2).

Tokens are a text's words with A-Z lower-cased, then one end. Counts of all training tokens are gathered
by aggregation over every training document. The model is a recurrent one (``gru``) over the end, the
most frequent words and one id for all rarer words; a rare word's probability is that id's times its share
of the rare words' counts, with one count added to each and one more for all words never seen. So the
model is a distribution over the same tokens as the unigram base. Training takes
every document once, in rounds; in each, tasks train from the common weights on their own documents, and
the weights and the sums of squares that their steps go by are averaged by tokens in a tree. There are ``ROUNDS``, and one more for each doubling of the
tokens beyond ``ROUND_TOKENS``.

The most frequent words, ``HEAD`` at most, are broadcast; the rest of each text's words get their counts
by an equi-join on the word (none of which is frequent), and sums return to the texts by aggregation.

Defined results: a null or empty text is one end token; rows with a null key are scored but never learned
from; repeated rows are scored alike; without training tokens N and V are 0; other columns of the input
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import by_batch, column, dropped, importable, pieces, saved

HEAD, VOCABULARY = 300_000, 2048
SAMPLE, ROUNDS, ROUND_TOKENS = 1, 2, 1 << 24
#: Texts, and their tokens, that are dealt to lanes together.
_TEXTS, _TOKENS = 4096, 1 << 21
#: Bytes of words that a task holds before it counts them and hands the counts on; models that one task adds up.
_HELD, _FAN_IN = 1 << 25, 16
END, RARE = 0, 1  # ids; the words follow


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, without the end."""
    return text.encode().lower().split() if text else []


def words_of(found: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of some texts, one text after another, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(found, "")))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # there are empty strings around blanks at a text's ends
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real).cast(pa.binary()), np.diff(upto[split.offsets.to_numpy()])


def counted(training: DataFrame, text: str = "text") -> DataFrame:
    """(word: binary, c: long); the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0

        def out():
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            held.clear()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "c"])

        for batch in batches:
            for piece in pieces(batch):
                flat, n = words_of(column(piece, "text"))
                held.append(flat)
                ends += len(n)
                if sum(x.nbytes for x in held) > _HELD:
                    yield out()
        if held:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    importable(training.sparkSession)
    return training.select(F.col(text).alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words with their counts, and totals of all."""

    def __init__(self, head: list[bytes], c: np.ndarray, n_tokens: int, n_words: int, least: int, vocabulary: int = VOCABULARY):
        """head: by falling count, all words counted ``least`` times or more, and the end (the empty word) if it was counted; n_words: distinct tokens."""
        self.n, self.v, self.head, self.least = n_tokens, n_words, head, least
        ends = head.index(b"") if b"" in head else None
        self.c = np.append(c, 0)  # the last for words that aren't in the head
        self.end = ends if ends is not None else len(head)
        own = [k for k in range(len(head)) if k != ends][: vocabulary - 2]
        self.id = np.full(len(head) + 1, RARE, np.int64)
        self.id[own] = np.arange(2, 2 + len(own))
        self.id[self.end] = END
        self.words, self.own = pa.array(head, pa.binary()), pa.array([head[k] for k in own], pa.binary())
        rare_n, rare_v = n_tokens - int(self.c[own].sum()) - int(self.c[self.end] if ends is not None else 0), n_words - len(own) - (ends is not None)
        self.rare = np.log10(rare_n + rare_v + 1)
        self.counts = np.zeros(-(-max(2 + len(own), 2) // gru.PER_CLASS) * gru.PER_CLASS)
        self.counts[END], self.counts[RARE] = self.c[self.end] if ends is not None else 0, rare_n
        self.counts[2 : 2 + len(own)] = self.c[own]

    def base(self) -> float:
        """What the unigram base subtracts for each token."""
        return float(np.log10(self.n + self.v + 1))


def rows_in(words: pa.Array, flat: pa.Array) -> np.ndarray:
    """The place of each word of ``flat`` among ``words`` (-1: none)."""
    return pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy()


def sequences(ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Model ids of each text, with its end, from those of all words."""
    upto = np.cumsum(n + 1)
    out = np.full(len(ids) + len(n), END, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return [out[a:b] for a, b in zip((upto - n - 1).tolist(), upto.tolist(), strict=True)]


def vocabulary_of(counts: DataFrame, head: int = HEAD, vocabulary: int = VOCABULARY) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # how many words there are from each of at most a thousand counts on
    sizes = counts.groupBy(F.floor(16 * F.log2("c")).alias("b")).agg(F.min("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("b")).toArrow()
    fits = sizes["c"].to_numpy()[np.cumsum(sizes["n"].to_numpy()) <= head] if sizes.num_rows else np.zeros(0)
    least = int(fits[-1]) if len(fits) else int(v) + int(n) + 1
    rows = counts.where((F.col("c") >= least) | (F.length("word") == 0)).toArrow()
    words, c = rows["word"].to_pylist(), rows["c"].to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-c[k], words[k]))
    return Vocabulary([words[k] for k in order], c[order] if order else np.zeros(0, np.int64), int(n), int(v), least, vocabulary)


def trained(training: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, rounds: int | None = None) -> dict[str, np.ndarray]:
    """The recurrent model's weights."""
    spark = training.sparkSession
    importable(spark)
    rounds = rounds or ROUNDS + max(0, int(np.log2(max(1, vocabulary.n) / ROUND_TOKENS)))
    weights, squares = gru.initial(vocabulary.counts), None
    rows_from = training.where(F.pmod(F.xxhash64(F.lit("lm"), key), F.lit(sample)) == 0)
    for k in range(rounds):
        start = spark.sparkContext.broadcast((vocabulary.own, weights, squares))
        part = rows_from.where(F.pmod(F.xxhash64(F.lit("round"), key), F.lit(rounds)) == k).select(F.col(text).alias("text"))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, weights, squares = start.value
            trainer, held = gru.Trainer(weights, squares), []

            def learn():
                trainer.train(held, END)
                held.clear()

            for batch in batches:
                for i in range(0, batch.num_rows, 256):  # the words of so many texts are held at once
                    flat, n = words_of(column(batch.slice(i, 256), "text"))
                    held += sequences(np.where((row := rows_in(own, flat)) < 0, RARE, row + 2), n)
                    if len(held) >= _TEXTS or sum(map(len, held)) >= _TOKENS:
                        learn()
            if held:
                learn()
            if trainer.seen:
                yield _model(TaskContext.get().partitionId(), trainer.seen, np.concatenate([gru.packed(trainer.p), gru.packed(trainer.squares)]) * trainer.seen)

        models, path = saved(spark, part.mapInArrow(run, _MODEL), "models")
        while models.count() > 1:
            models = models.withColumn("task", F.expr(f"task div {_FAN_IN}"))
            fewer, new_path = saved(spark, models.groupBy("task").applyInArrow(_added, _MODEL), "models")
            dropped(spark, path)
            models, path = fewer, new_path
        if row := models.first():
            both = np.frombuffer(row.weights, np.float32) / row.seen
            weights, squares = gru.unpacked(both[: len(both) // 2], weights), gru.unpacked(both[len(both) // 2 :], weights)
        dropped(spark, path)
    return weights


_MODEL = "task long, seen long, weights binary"


def _model(task: int, seen: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([seen], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["task", "seen", "weights"])


def _added(models: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float32) for x in models["weights"].to_pylist()], axis=0)
    return pa.Table.from_batches([_model(models["task"][0].as_py(), sum(models["seen"].to_pylist()), total)])


def scored(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities."""
    spark = docs.sparkSession

    def make():
        task, done = TaskContext.get().partitionId(), 0
        log_c = np.log10(vocabulary.c + 1.0)
        rare = vocabulary.id == RARE

        def run(batch):
            nonlocal done
            size = batch.num_rows
            flat, n = words_of(column(batch, text))
            row, doc = rows_in(vocabulary.words, flat), np.repeat(np.arange(size), n)
            total = lambda x: np.bincount(doc, x, size)
            outside = np.flatnonzero(row < 0)
            tail = pa.table({"doc": doc[outside], "word": flat.take(pa.array(outside))}).group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
            of_tail = pa.StructArray.from_arrays([tail["word"].combine_chunks(), tail["count_all"].combine_chunks().cast(pa.int32())], names=["word", "n"])
            model = gru.log_likelihood(weights, sequences(vocabulary.id[row], n), END) / np.log(10)
            row_id = (task << 33) + done + np.arange(size)
            done += size
            return {
                "_row": row_id, key: column(batch, key), "n_tokens": n + 1,
                "n_known": total(vocabulary.c[row] > 0).astype(np.int64) + (vocabulary.c[vocabulary.end] > 0), "base": total(log_c[row]) + log_c[vocabulary.end],
                "score": total(np.where(rare[row], log_c[row] - vocabulary.rare, 0.0)) + model,
                "tail": pa.ListArray.from_arrays(pa.array(np.searchsorted(tail["doc"].to_numpy(), np.arange(size + 1)), pa.int32()), of_tail),
            }

        return run

    schema = f"_row long, {key} long, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, n: int>>"
    first, _ = saved(spark, by_batch(docs, [F.col(key).cast("long").alias(key), F.col(text).alias("text")], make, schema), "scores")
    words = first.select("_row", F.explode("tail").alias("x")).select("_row", "x.word", "x.n")
    sums = (
        words.join(counts.where((F.col("c") < vocabulary.least) & (F.length("word") > 0)), "word")
        .groupBy("_row")
        .agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_log"))
    )
    more = F.coalesce("_log", F.lit(0.0))
    return first.drop("tail").join(sums, "_row", "left").select(
        key, "n_tokens", (F.col("n_known") + F.coalesce("_n", F.lit(0))).cast("long").alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(vocabulary.base())).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD, vocabulary: int = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """Scores of every row of ``docs`` by a model of the rows of ``training``."""
    counts, _ = saved(docs.sparkSession, counted(training, text), "unigrams")
    known = vocabulary_of(counts, head, vocabulary)
    return scored(docs, counts, known, trained(training, known, key, text, sample), key, text)
