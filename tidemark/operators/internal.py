"""Rules on engines, transfers, scheduling and accounting. Each gives (run_id, code, key, detail).

Every rule is an aggregation of one side and a left join from the side it speaks of, so that what is missing shows;
rules on the same join are evaluated together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.events import sequence_gaps, violations

#: Fixed value: names of decode engines by the side a request was routed to.
DECODERS = ("decode-0", "decode-1")


def coded(df: DataFrame, rules: dict[str, Column], key: Column, run: str = "run_id", detail: Column | None = None) -> DataFrame:
    """A violation for each rule that holds of a row; what is unknown doesn't hold."""
    codes = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    detail = F.lit(None).cast("string") if detail is None else detail
    rows = df.select(F.col(run).alias("run_id"), key.cast("string").alias("_key"), detail.cast("string").alias("_detail"), F.explode(codes).alias("_code"))
    return violations(rows, F.col("_code"), F.col("_key"), F.col("_detail"))


def engine_rules(attempts: DataFrame, engines: DataFrame) -> DataFrame:
    """attempts: (run_id, request_id, prefilled: boolean, decoder: the engine of its route or null); engines: (request_id, component), one row for each engine request."""
    decode = F.col("component").isin(*DECODERS)
    g = engines.groupBy("request_id").agg(F.count_if(F.col("component") == "prefill").alias("_p"), F.count_if(decode).alias("_d"), F.min(F.when(decode, F.col("component"))).alias("_c"))
    rows = attempts.join(g, "request_id", "left").fillna(0, ["_p", "_d"])
    routed = F.col("decoder").isNotNull()
    rules = {
        "accepted_attempt_missing_prefill_engine": F.col("prefilled") & (F.col("_p") == 0),
        "routed_attempt_decode_engine_cardinality": routed & (F.col("_d") != 1),
        "proxy_route_worker_mismatch": routed & (F.col("_d") == 1) & (F.col("_c") != F.col("decoder")),
    }
    return coded(rows, rules, F.col("request_id"), detail=F.col("_d"))


def transfer_rules(attempts: DataFrame, transfers: DataFrame, ranks: DataFrame) -> DataFrame:
    """Of routed attempts. transfers: (run_id, request_id, success, ready_ns, bytes, missing: array); ranks: (request_id, engine, started, completed, failed)."""
    routed = attempts.where("decoder is not null")
    one = F.min(F.struct(F.coalesce("success", F.lit(False)).alias("success"), "ready_ns", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.size("missing").alias("missing")))
    g = transfers.groupBy("request_id").agg(F.count("*").alias("_n"), one.alias("_t"))
    engines = ranks.groupBy("request_id").agg(F.min("engine").alias("_lo"), F.max("engine").alias("_hi"), F.count_if(F.col("engine").isNull()).alias("_none"))
    rows = routed.join(g, "request_id", "left").fillna(0, ["_n"]).join(engines, "request_id", "left")
    single = F.col("_n") == 1
    same = (F.col("_lo") == F.col("decoder")) & (F.col("_hi") == F.col("decoder")) & (F.col("_none") == 0)
    rules = {
        "pd_attempt_kv_transfer_cardinality": F.col("_n") != 1,
        "pd_attempt_kv_transfer_failed": single & ~F.col("_t.success"),
        "pd_attempt_kv_ready_missing": single & F.col("_t.ready_ns").isNull(),
        "pd_attempt_kv_bytes_missing": single & (F.col("_t.bytes") <= 0),
        "pd_attempt_kv_rank_missing": single & (F.coalesce("_t.missing", F.lit(0)) > 0),
        "proxy_route_kv_worker_mismatch": single & ~F.coalesce(same, F.lit(False)),
    }
    out = coded(rows, rules, F.col("request_id"), detail=F.col("_n"))
    absent = routed.groupBy("run_id").agg(F.count("*").alias("_n")).join(transfers.select("run_id").distinct(), "run_id", "left_anti")
    return out.unionByName(violations(absent, "kv_telemetry_missing_for_pd_run", F.lit(None), F.col("_n")))


def rank_rules(ranks: DataFrame) -> DataFrame:
    """ranks: (run_id, request_id, started, completed, failed)."""
    n = lambda c: F.coalesce(c, F.lit(0))
    rules = {"kv_complete_without_start": (n("completed") > 0) & (n("started") == 0), "kv_transfer_missing_terminal": n("started") != n("completed") + n("failed")}
    return coded(ranks, rules, F.col("request_id"))


def membership_rules(iterations: DataFrame, members: DataFrame, keys: list[str] = ("process", "iteration_id")) -> DataFrame:
    """iterations: (run_id, keys, total, count); members: (keys, scheduled). Memberships without an iteration are left out."""
    g = members.groupBy(*keys).agg(F.sum("scheduled").alias("_s"), F.count("*").alias("_c"))
    rows = iterations.join(g, [*keys], "left").fillna(0, ["_s", "_c"])
    rules = {"membership_token_sum_mismatch": F.col("_s") != F.col("total"), "membership_count_mismatch": F.col("_c") != F.col("count")}
    return coded(rows, rules, F.concat_ws("/", *keys))


def accounting_rules(prefills: DataFrame) -> DataFrame:
    """prefills: (run_id, request_id, exact); unknown counts as unproven."""
    return coded(prefills, {"prefill_accounting_unproven": ~F.coalesce("exact", F.lit(False))}, F.col("request_id"))


def log_rules(events: DataFrame, summaries: DataFrame, damaged: DataFrame, process: str = "process", seq: str = "seq") -> DataFrame:
    """What all logs have in common. events: (run_id, process, seq); summaries: (run_id, process, enqueued, written); damaged: (run_id, file, damage)."""
    gaps = sequence_gaps(events, ["run_id", process], seq)
    out = coded(gaps, {"event_seq_gap": (F.col("missing") > 0) | (F.col("duplicates") > 0)}, F.col(process), detail=F.concat_ws(" ", F.lit("missing"), "missing", F.lit("duplicates"), "duplicates"))
    n = lambda c: F.coalesce(c, F.lit(0))
    out = out.unionByName(coded(summaries, {"writer_counter_mismatch": n("written") != n("enqueued")}, F.col(process)))
    return out.unionByName(violations(damaged, "jsonl_damaged_line", F.col("file"), F.col("damage")))
