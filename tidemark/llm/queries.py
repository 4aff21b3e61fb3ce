"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, divergence, hardneg, langid, linededup, lmscore, mixing, packing, quality, rans, simhash, toxicity
from tidemark.llm.common import documents, fold, new_path

OP3_SQL = """
WITH lines AS (
    SELECT doc_id, source, i, u.line, trim(u.line, ' ') AS t
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)
),
wide AS (SELECT t, min(doc_id) AS first FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 8),
marked AS (
    SELECT l.doc_id, l.i, l.line,
           w.t IS NULL OR (l.doc_id = w.first AND row_number() OVER (PARTITION BY l.doc_id, l.t ORDER BY l.i) = 1) AS stays
    FROM lines l LEFT JOIN wide w ON l.t = w.t
)
SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS n_lines_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text
FROM marked GROUP BY doc_id
"""

OP12_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
),
negatives AS (
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT * FROM negatives WHERE rank <= 5
"""

OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (
    SELECT d, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)
),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 3),
langs AS (SELECT l.lang, count(term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept USING (lang) GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT s.lang, s.source, coalesce(sum(n), 0) AS n FROM sources s LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS count, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + l.v) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS BIGINT) AS q
    FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
every AS (
    SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE count > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= 200
"""

#: Shares of the expected tokens by domain.
TARGETS = {"good": 0.90, "low": 0.08, "toxic": 0.02}
BPE_JSON, END_ID, PACK_END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2, 0
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0").select("vec_id"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    return lmscore.score(docs, docs.where(~held_out)).withColumn("held_out", held_out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return linededup.dedup(docs).select("doc_id", "n_lines_removed", "text")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 5) == 0
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    scores = toxicity.score(docs, toxicity.learn(docs, labels))
    return scores.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    rans.write(documents(spark, sf_dir).select("doc_id", "text"), folder, BPE_JSON, END_ID)
    return rans.read_digests(spark, folder)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = mixing.mixed_rates(documents(spark, sf_dir).select("doc_id", "text"), labels, TARGETS)
    names = [F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    names += [F.col(c)[i].alias(f"{c}_{d}") for c in ("reached", "aimed") for i, d in enumerate(sorted(TARGETS))]
    return found.select("doc_id", "n_tokens", "rate", *names)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), BPE_JSON, PACK_END_ID)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")), 100)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir).select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ann, op2_lm_score, op3_line_dedup, op4_langid, op5_byte_bpe, op6_toxicity, op7_rans, op8_quality, op9_mixing, op10_simhash, op11_packing, op12_hard_negatives, op13_divergence]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op12_hard_negatives": OP12_SQL, "op13_divergence": OP13_SQL}
