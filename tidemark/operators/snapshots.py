"""Rules on snapshot windows, stock and flow, and run contracts. Each rule gives (run_id, code, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.events import violations


def numbers(rows: DataFrame, vector: str) -> DataFrame:
    """Vectors with a component that isn't finite or is negative."""
    v = F.col(vector)
    nan, inf = F.exists(v, lambda x: F.isnan(x)), F.exists(v, lambda x: F.abs(x) == float("inf"))
    negative = F.exists(v, lambda x: ~F.isnan(x) & (x < 0))
    rules = F.array_compact(F.array(F.when(nan, F.lit("numeric_nan")), F.when(inf, F.lit("numeric_inf")), F.when(negative, F.lit("numeric_negative"))))
    return violations(rows.select("run_id", "window_id", F.explode(rules).alias("c")), F.col("c"), F.col("window_id"), F.lit(None))


def contiguity(rows: DataFrame, period: int) -> DataFrame:
    """Window numbers, lengths and coverage: each window follows the one before it in its run."""
    w = W.partitionBy("run_id").orderBy("window_id")
    checks = (
        ("window_index_gap", F.col("window_id") != F.lag("window_id").over(w) + 1), ("window_coverage_gap", F.col("start_ns") != F.lag("end_ns").over(w)),
        ("window_period_mismatch", F.col("end_ns") - F.col("start_ns") != period),
    )
    rules = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))
    return violations(rows.withColumn("_c", rules).select("run_id", "window_id", F.explode("_c").alias("c")), F.col("c"), F.col("window_id"), F.lit(None))


def shift(rows: DataFrame, state: str = "x", after: str = "x_next") -> DataFrame:
    """The next state of a window must be the state of the window after it."""
    w = W.partitionBy("run_id").orderBy("window_id")
    return violations(rows.withColumn("_n", F.lead(state).over(w)).where(F.col("_n").isNotNull() & (F.col("_n") != F.col(after))), "next_state_shift_mismatch", F.col("window_id"), F.lit(None))


def stock_flow(rows: DataFrame, stock: str, inflows: list[str], outflows: list[str], code: str = "request_inventory_conservation") -> DataFrame:
    """Stock at the next window = stock + inflows - outflows."""
    w = W.partitionBy("run_id").orderBy("window_id")
    add = lambda xs: reduce(lambda a, b: a + F.coalesce(F.col(b), F.lit(0)), xs, F.lit(0))
    expected = F.col(stock) + add(inflows) - add(outflows)
    bad = rows.withColumn("_e", expected).withColumn("_n", F.lead(stock).over(w)).where("_n is not null and abs(_n - _e) > 1e-9")
    return violations(bad, code, F.col("window_id"), F.concat_ws(" ", F.lit("expected"), "_e", F.lit("found"), "_n"))


def valid_share(rows: DataFrame, least: float = 0.99) -> DataFrame:
    """Runs of which too few windows are valid; a share equal to the gate fails too."""
    g = rows.groupBy("run_id").agg(F.avg(F.col("valid").cast("double")).alias("share")).where(F.col("share") <= least)
    return violations(g, "valid_window_ratio_below_gate", F.lit(None), F.col("share"))


def monotone(rows: DataFrame, rank: str, keys: list[str], order: str) -> DataFrame:
    """States that go back in their order."""
    w = W.partitionBy("run_id", *keys).orderBy(order)
    return violations(rows.withColumn("_b", F.lag(rank).over(w)).where(F.col(rank) < F.col("_b")), "request_state_transition_invalid", F.concat_ws("/", *keys), F.col(order))


def stages(rows: DataFrame, whole: str, parts: list[str]) -> DataFrame:
    """The inventories of all stages add up to the whole, in a window's state and in its next state (name_next)."""
    add = lambda names: reduce(lambda a, b: a + F.coalesce(F.col(b), F.lit(0)), names, F.lit(0))
    bad = rows.where((add(parts) != F.col(whole)) | (add([f"{p}_next" for p in parts]) != F.col(f"{whole}_next")))
    return violations(bad, "stage_inventory_conservation", F.col("window_id"), F.lit(None))


def transfer_lifecycles(transfers: DataFrame) -> DataFrame:
    """transfers: (run_id, request_id, enqueue_ns, start_ns, ready_ns, first_byte_ns, done, expected, missing: int, bytes, success). The detail lists the reasons."""
    n = lambda c: F.coalesce(c, F.lit(0))
    ordered = (F.col("enqueue_ns") <= F.col("start_ns")) & (F.col("start_ns") <= F.col("ready_ns"))
    reasons = {
        "time_order": ~F.coalesce(ordered, F.lit(False)), "ready_after_decode_first_byte": F.col("ready_ns") > F.col("first_byte_ns"), "rank_count": n("done") != n("expected"),
        "missing_ranks": n("missing") > 0, "bytes": n("bytes") <= 0, "failed": ~F.coalesce("success", F.lit(False)),
    }
    found = transfers.withColumn("_r", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in reasons.items())))).where(F.size("_r") > 0)
    return violations(found, "kv_lifecycle_violation", F.col("request_id"), F.array_join("_r", ","))


def measurement(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """windows: (run_id, segment); runs: (run_id, start_ns, end_ns, period_ms): as many windows as the measurement has periods, and no others."""
    g = windows.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(~F.col("segment").eqNullSafe(F.lit("measurement"))).alias("other"))
    rows = runs.join(g, "run_id", "left").fillna(0, ["n", "other"])
    wanted = F.call_function("div", F.col("end_ns") - F.col("start_ns"), F.col("period_ms").cast("long") * 1_000_000)
    rules = {"measurement_window_count_mismatch": F.col("n") != wanted, "non_measurement_window_in_training_snapshot": F.col("other") > 0}
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return violations(rows.select("run_id", "n", F.explode(codes).alias("c")), F.col("c"), F.lit(None), F.col("n"))


def row_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Every part of a run's snapshot (each with run_id) must have as many rows as the others; a run that lacks a part has 0 there."""
    counts = reduce(DataFrame.unionByName, [df.groupBy("run_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in parts.items()])
    g = counts.groupBy("run_id").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).where((F.col("k") < len(parts)) | (F.col("lo") != F.col("hi")))
    return violations(g, "snapshot_row_count_mismatch", F.lit(None), F.concat_ws(" ", "lo", "hi"))


def files(runs: DataFrame, found: DataFrame, required: list[str]) -> DataFrame:
    """runs: (run_id); found: (run_id, file): each run has each required file."""
    wanted = runs.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, required))).alias("file"))
    return violations(wanted.join(found.select("run_id", "file").distinct(), ["run_id", "file"], "left_anti"), "derived_file_missing", F.col("file"), F.lit(None))


def reports(runs: DataFrame, found: DataFrame, required: tuple[str, ...] = ("internal", "proxy")) -> DataFrame:
    """found: (run_id, report, violations): each run has each earlier report, and none has violations."""
    wanted = runs.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, required))).alias("report"))
    g = found.groupBy("run_id", "report").agg(F.sum(F.coalesce("violations", F.lit(0))).alias("n"))
    rows = wanted.join(g, ["run_id", "report"], "left")
    code = F.when(F.col("n").isNull(), "quality_report_missing").when(F.col("n") > 0, "upstream_quality_violation")
    return violations(rows.withColumn("_c", code).where("_c is not null"), F.col("_c"), F.col("report"), F.col("n"))


def writers(summaries: DataFrame) -> DataFrame:
    """summaries: (run_id, file, enqueued, written, lost): what was written is what came in, and nothing was lost on the way."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return violations(summaries.where(~F.col("written").eqNullSafe(F.col("enqueued")) | (n("lost") > 0)), "writer_not_balanced", F.col("file"), F.lit(None))


def raw_logs(lines: DataFrame) -> DataFrame:
    """lines: (run_id, process, seq, damaged): damaged lines of a run, and processes whose sequences lack or repeat numbers."""
    bad = lines.groupBy("run_id").agg(F.count_if("damaged").alias("n")).where("n > 0")
    g = lines.where("not damaged and process is not null and seq is not null").groupBy("run_id", "process").agg(F.max("seq").alias("hi"), F.countDistinct("seq").alias("d"), F.count("*").alias("n"))
    return violations(bad, "jsonl_damaged", F.lit(None), F.col("n")).unionByName(violations(g.where("hi <> d or n <> d"), "event_seq_gap", F.col("process"), F.col("n")))


def digests(sealed: DataFrame, found: DataFrame, code: str = "snapshot_manifest_mismatch") -> DataFrame:
    """(run_id, file, sha256) as written down and as found now: files that are gone or differ. With another code, frozen schemas."""
    both = sealed.select("run_id", "file", F.col("sha256").alias("_a")).join(found.select("run_id", "file", F.col("sha256").alias("_b")), ["run_id", "file"], "left")
    return violations(both.where(~F.col("_a").eqNullSafe(F.col("_b"))), code, F.col("file"), F.lit(None))


def run_isolation(runs: DataFrame) -> DataFrame:
    """Runs that are in more than one split."""
    return violations(runs.groupBy("run_id").agg(F.countDistinct("split").alias("n")).where("n > 1"), "run_in_two_splits", F.lit(None), F.col("n"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
