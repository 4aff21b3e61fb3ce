"""How far the sources of a language diverge in their terms (operator 13).

Terms are the runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Each task counts its
documents' terms with DuckDB in bounded pieces; the counts are dealt by (language, term) and merged, so
that neither a large source nor a large language nor a frequent term is one task's work. In each part DuckDB
keeps the terms of ``least_docs`` documents of the language; Spark adds up what every source and language needs
from all of them (its occurrences and the language's number of terms). Then the kept rows are dealt to shards by
(language, term), DuckDB makes each shard's partial sums for all pairs of sources and its best terms of each source,
and Spark merges the sums and the rankings. A shard gives a row for every pair, so there are as many shards as the
kept rows need, however many partitions Spark shuffles to.

A term counts for every pair of its language's sources, also where neither has it. Those that neither has all
give the same, and those that one of them has depend on its count alone, so a shard counts counts; only sources
that share a term meet, as a correction.

Arithmetic is exact: products that exceed 64 bits are made in DuckDB's 128-bit integers, sums across shards in
38-digit decimals.

Defined results: null texts, languages and sources are ''; a source without terms still is in every pair of its
language; a language without kept terms gives pairs of value 0; repeated rows count as often as they occur; an
empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, importable, pieces, saved, texts

LEAST_DOCS, MOST_TERMS = 3, 200
#: Distinct (document, term) pairs that a task counts at once; memory that DuckDB takes in a task before it spills.
PAIRS, MEMORY = 1_000_000, "400MB"
#: Rows of a shard, but for the unevenness of hashing; fewer, but so many at least, while there are no more than ``FEW`` shards.
SHARD_ROWS, LEAST_ROWS, FEW = 250_000, 10_000, 16
#: Every byte of ASCII that isn't a letter becomes a blank; A-Z become a-z.
_FOLD = bytes(i if i > 127 or chr(i).islower() else i + 32 if chr(i).isupper() else 32 for i in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _sql(sql: str, **tables: pa.Table) -> pa.Table:
    import duckdb

    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill}) as con:
        for name, table in tables.items():
            con.register(name, table)
        return con.sql(sql).to_arrow_table()


def _batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches(max_chunksize=50_000)


_COUNTED = pa.schema({"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()})
_COUNT = "SELECT lang, source, decode(term) AS term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM found JOIN groups USING (g) GROUP BY ALL"


def counted(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n, docs), by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        g, found, n = [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(groups)
            table = _sql(
                _COUNT,
                found=pa.table({"g": pa.array(g, pa.int32()), "term": pa.array(found, pa.binary()), "n": pa.array(n, pa.int64())}),
                groups=pa.table({"g": pa.array(range(len(keys)), pa.int32()), "lang": pa.array([k[0] for k in keys], pa.string()), "source": pa.array([k[1] for k in keys], pa.string())}),
            )
            groups.clear()
            for x in (g, found, n):
                x.clear()
            yield from _batches(table, _COUNTED)

        for batch in batches:
            for part in pieces(batch):
                for lang, source, text in zip(column(part, "lang").to_pylist(), column(part, "source").to_pylist(), texts(part), strict=True):
                    own = Counter(terms(text))
                    if own:
                        place = groups.setdefault((lang, source), len(groups))
                        g += [place] * len(own)
                        found += own.keys()
                        n += own.values()
                        if len(g) >= PAIRS:
                            yield from out()
        if g:
            yield from out()

    importable(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


_KEPT = pa.schema({"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "total": pa.int64(), "first": pa.bool_()})
_KEEP = """
SELECT lang, source, term, n, total, source = first AS first
FROM counts JOIN (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total, min(source) AS first FROM counts GROUP BY lang, term HAVING sum(docs) >= {least}) USING (lang, term)
"""


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, total, first) of the kept terms; a partition of counts has all of its terms' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if whole:
            yield from _batches(_sql(_KEEP.format(least=least_docs), counts=pa.Table.from_batches(whole)), _KEPT)

    return counts.mapInArrow(run, "lang string, source string, term string, n long, total long, first boolean")


#: n, v: a source's occurrences and its language's terms; p0, p: what an absent and a present term have there.
_SHARD = """
WITH g AS (SELECT lang, source, n + v AS d, 1 + CAST(1000000000 // (n + v) AS BIGINT) AS p0, lang_n + v AS lang_d FROM groups WHERE v > 0),
k AS (
    SELECT lang, source, term, p0, CAST(1 + 1000000000::HUGEINT * (kept.n + 1) // d AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (total + 1) // lang_d AS BIGINT) AS q
    FROM kept JOIN g USING (lang, source)
),
sizes AS (SELECT lang, count(*) AS v FROM kept WHERE first GROUP BY lang),
kinds AS (SELECT lang, source, p0, p, count(*) AS m FROM k GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, b.source AS item, v * ((a.p0 - b.p0) * (a.p0 - b.p0) // b.p0)::HUGEINT AS value
    FROM g a JOIN g b USING (lang) JOIN sizes USING (lang) WHERE a.source <> b.source
    UNION ALL
    SELECT a.lang, a.source, b.source, sum(m::HUGEINT * ((a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0))
    FROM kinds a JOIN g b USING (lang) WHERE a.source <> b.source GROUP BY ALL
    UNION ALL
    SELECT a.lang, a.source, b.source, sum(m::HUGEINT * ((a.p0 - b.p) * (a.p0 - b.p) // b.p - (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0))
    FROM g a JOIN kinds b USING (lang) WHERE a.source <> b.source GROUP BY ALL
    UNION ALL
    SELECT a.lang, a.source, b.source,
           sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0) - sum((a.p0 - b.p) * (a.p0 - b.p) // b.p - (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0)
    FROM k a JOIN k b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
),
best AS (
    SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM k WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) <= {most}
)
SELECT lang, source, 'pair' AS part, item, CAST(sum(value) AS DECIMAL(38, 0)) AS value FROM parts GROUP BY ALL
UNION ALL SELECT lang, source, 'term', item, CAST(value AS DECIMAL(38, 0)) FROM best
"""
_PARTIAL = pa.schema({"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.decimal128(38, 0)})


def shards_of(rows: int) -> int:
    return max(1, min(FEW, -(-rows // LEAST_ROWS)), -(-rows // SHARD_ROWS))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank); docs: (text, lang, source)."""
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept, _ = saved(spark, kept_terms(sums, least_docs), "kept")

    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"))
    lang = Window.partitionBy("lang")
    groups, _ = saved(
        spark,
        docs.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").na.fill(0, ["n", "firsts"])
        .select("lang", "source", "n", F.sum("firsts").over(lang).alias("v"), F.sum("n").over(lang).alias("lang_n")),
        "groups",
    )
    shards = shards_of(kept.count())
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def shard_sums(one: pa.Table, two: pa.Table) -> pa.Table:
        return _sql(_SHARD.format(most=most_terms), kept=one, groups=two).cast(_PARTIAL) if one.num_rows else _PARTIAL.empty_table()

    found, _ = saved(spark, kept.groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInArrow(shard_sums, "lang string, source string, part string, item string, value decimal(38,0)"), "partial")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    sums = found.where("part = 'pair'").unionByName(pairs).groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("value", F.col("value").cast("long")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return sums.withColumn("rank", F.row_number().over(order)).unionByName(best)
