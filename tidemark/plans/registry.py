"""Registered queries with their SQL, and the supplied tables read as telemetry."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import DAY_NS, epoch_ns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The supplied tables, and views of them in the shape of telemetry.

    ev: event log (run_id, process, seq, ts_ns, event_type, value, k, event_id); att: one row for each
    request; em: token emissions and memberships; life: requests with the times of their states.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.events.selectExpr(
            "concat('run-', user_id % 3) AS run_id", "user_id AS process", "event_type", "value", "event_id", "props",
            "cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS seq",
            "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000L AS ts_ns",
            "cast(get_json_object(props, '$.k') AS bigint) AS k",
        )

    @cached_property
    def att(self) -> DataFrame:
        return self.orders.select(
            F.expr("cast(year(o_orderdate) AS bigint) AS run"), F.col("o_orderkey").alias("request_id"), F.expr("o_orderkey div 2 AS trace_id"), F.expr("o_orderkey % 2 AS attempt_id"),
            epoch_ns("o_orderdate").alias("arrival_ns"), F.expr("cast(floor(o_totalprice / 100) AS bigint) AS input_tokens"), F.expr("cast(floor(o_totalprice / 1000) AS bigint) AS expected_tokens"),
            F.col("o_orderstatus").alias("status"), F.expr("o_custkey % 2 AS side"), F.col("o_orderpriority").alias("workload"), F.col("o_custkey").alias("client"),
        )

    @cached_property
    def em(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("long").alias("seq"), (epoch_ns("l_shipdate") + F.col("l_linenumber") * F.lit(3_600_000_000_000)).alias("ts_ns"),
            F.col("l_quantity").cast("long").alias("n"), F.expr("l_suppkey % 2 AS side"), F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'prefill' WHEN 1 THEN 'decode-0' ELSE 'decode-1' END AS component"),
            F.col("l_suppkey").alias("rank"),
        )

    @cached_property
    def life(self) -> DataFrame:
        return self.att.selectExpr("*", *(f"{e} AS {n}" for n, e in LIFE.items()))


#: Times of states as arithmetic on the request id; some are null and some out of order.
_D = f"{DAY_NS}"
LIFE = {
    "accepted": "request_id % 11 <> 0",
    "terminal_event": "CASE WHEN request_id % 13 = 0 THEN 'request_rejected' WHEN request_id % 17 = 0 THEN 'request_cancel' WHEN request_id % 19 = 0 THEN 'request_error' ELSE 'request_complete' END",
    "submit_ns": f"CASE WHEN request_id % 23 <> 0 THEN arrival_ns + (request_id % 5) * {_D} END",
    "prefill_scheduled_ns": f"CASE WHEN request_id % 7 <> 0 THEN arrival_ns + (request_id % 5 + request_id % 3) * {_D} END",
    "prefill_added_ns": f"arrival_ns + (request_id % 5 + 1) * {_D}",
    "prefill_terminal_ns": f"CASE WHEN request_id % 29 <> 0 THEN arrival_ns + (request_id % 5 + request_id % 3 + request_id % 7) * {_D} END",
    "prefill_complete_ns": f"CASE WHEN request_id % 31 <> 0 THEN arrival_ns + (request_id % 5 + request_id % 7 + 1) * {_D} END",
    "kv_enqueue_ns": f"CASE WHEN request_id % 37 <> 0 THEN arrival_ns + (10 + request_id % 4) * {_D} END",
    "kv_start_ns": f"arrival_ns + (12 + request_id % 6) * {_D}",
    "kv_ready_ns": f"CASE WHEN request_id % 41 <> 0 THEN arrival_ns + (14 + request_id % 9) * {_D} END",
    "decode_added_ns": f"arrival_ns + (16 + request_id % 8) * {_D}",
    "decode_scheduled_ns": f"CASE WHEN request_id % 6 <> 0 THEN arrival_ns + (18 + request_id % 10) * {_D} END",
    "terminal_ns": f"CASE WHEN request_id % 43 <> 0 THEN arrival_ns + (30 + request_id % 40) * {_D} END",
}

#: The same views in DuckDB's SQL.
VIEWS = f"""WITH ev AS (
    SELECT 'run-' || (user_id % 3) AS run_id, user_id AS process, event_type, value, event_id, props,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) * 1000 AS ts_ns, CAST(props->>'$.k' AS BIGINT) AS k
    FROM events),
att AS (
    SELECT CAST(year(o_orderdate) AS BIGINT) AS run, o_orderkey AS request_id, o_orderkey // 2 AS trace_id, o_orderkey % 2 AS attempt_id,
           epoch_us(o_orderdate) * 1000 AS arrival_ns, CAST(floor(o_totalprice / 100) AS BIGINT) AS input_tokens, CAST(floor(o_totalprice / 1000) AS BIGINT) AS expected_tokens,
           o_orderstatus AS status, o_custkey % 2 AS side, o_orderpriority AS workload, o_custkey AS client
    FROM orders),
em AS (
    SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) AS seq, epoch_us(l_shipdate) * 1000 + l_linenumber * 3600000000000 AS ts_ns, CAST(l_quantity AS BIGINT) AS n,
           l_suppkey % 2 AS side, CASE l_suppkey % 3 WHEN 0 THEN 'prefill' WHEN 1 THEN 'decode-0' ELSE 'decode-1' END AS component, l_suppkey AS rank
    FROM lineitem),
life AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in LIFE.items())} FROM att)
"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables under its name (or another); sql: what follows the views, a select or further views."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLES[name or f.__name__] = (VIEWS + (body if body.startswith("SELECT") else ", " + body)).strip()
        return f

    return put


def normal_equations(rows: str, features: list[str], targets: list[str], penalty: float, free: int = 0) -> str:
    """CTEs that fit targets by ridge regression on features; the last, th, has b{feature}_{target}. The last ``free`` features aren't penalised."""
    n, m = len(features), len(targets)
    sums = [f"sum(CAST({x} AS DOUBLE) * {y}){f' + {penalty}' if i == j and i < n - free else ''} AS a{i}_{j}" for i, x in enumerate(features) for j, y in enumerate(features)]
    sums += [f"sum(CAST({x} AS DOUBLE) * {y}) AS b{i}_{k}" for i, x in enumerate(features) for k, y in enumerate(targets)]
    found = [f"el0 AS (SELECT {', '.join(sums)} FROM {rows})"]
    for p in range(n):  # elimination, one pivot at a time
        of = lambda x, i, j, p=p: f"{x}{p}_{j} / a{p}_{p}" if i == p else f"{x}{i}_{j} - a{i}_{p} * {x}{p}_{j} / a{p}_{p}"
        columns = [f"{of('a', i, j)} AS a{i}_{j}" for i in range(n) for j in range(p + 1, n)] + [f"{of('b', i, k)} AS b{i}_{k}" for i in range(n) for k in range(m)]
        found.append(f"{'th' if p == n - 1 else f'el{p + 1}'} AS (SELECT {', '.join(columns)} FROM el{p})")
    return ", ".join(found)
