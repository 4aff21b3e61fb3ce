"""From documents to token ids in five stages; part of the training-data operators.

Each stage takes (spark, docs, sf_dir) and gives a table, which is written as Parquet and read again as
the next stage's documents. All but the last give the columns of their input, whatever they are called.

1. language (4): drops documents without a letter and those whose language is doubtful. Null and empty texts
   have no letter and go; where no document has a language label nothing is doubtful, and all with a text stay.
2. lines (3): takes lines that spread over many sources out of all documents but the first. A null text stays
   null; a document of nothing else keeps an empty text; ``n_chars``, where there is one, is counted anew.
3. near_duplicates (10): SimHash with verified links; keeps the document with the smallest id of each component
   of documents whose five-word shingles have a Jaccard of 0.8 or more. Documents without words are one component;
   rows that repeat an id stay or go together; rows with a null id stay.
4. mixing (9): repeats or drops documents by rates that bring the expected tokens of each domain to its target.
   Rows that repeat an id get the highest of their rates; documents without tokens have rate 1 and stay.
5. bpe (5): gives the ids and checks that they decode to the text. A null text counts as empty.

Every stage gives an empty table for an empty one, and treats repeated rows alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, linededup, mixing, neardup
from tidemark.llm.common import documents, fold, importable, saved, unused
from tidemark.llm.queries import BPE_RANKS, TARGETS

#: Least posterior of the language of a document that stays.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    model = langid.fit(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where("text <> ''")
    name = unused(docs, "_language")
    found = docs.withColumn(name, langid.predicted(F.col("text"), model, spark))
    return found.where((F.col(name)["lang_pred"] != langid.UNKNOWN) & (F.col(name)["score"] >= LEAST_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = unused(docs, "_removed")  # dedup() gives a column of its own, n_lines_removed, which docs may have
    kept = docs.withColumnRenamed("n_lines_removed", own) if "n_lines_removed" in docs.columns else docs
    found = linededup.dedup(kept).drop("n_lines_removed").withColumnRenamed(own, "n_lines_removed")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    later = found.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("doc_id <> least").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rate, copy = unused(docs, "_rate"), unused(docs, "_copy")
    rates = mixing.mixed_rates(docs.select("doc_id", "text"), labels, TARGETS).groupBy("doc_id").agg(F.max("rate").alias(rate))
    taken = mixing.copies(F.col(rate), F.col("doc_id"))
    return docs.join(rates, "doc_id", "left").withColumn(copy, F.explode(F.array_repeat(F.lit(0), taken))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: Neither language identification nor SimHash, mixing or BPE can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = saved(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
