"""Rules on control signals: commands, levels, and what changes when."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.events import violations


def commands(applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each (run_id, command_id), and the violations of commands whose repeats differ in time or value."""
    g = applied.groupBy("run_id", "command_id").agg(F.min(F.struct("applied_ns", "u")).alias("x"), F.countDistinct("applied_ns", "u").alias("n"))
    return g.select("run_id", "command_id", "x.*"), violations(g.where("n > 1"), "conflicting_command", F.col("command_id"), F.col("n"))


def missing_levels(windows: DataFrame, levels: list[float]) -> DataFrame:
    """Runs that don't visit all levels."""
    seen = windows.groupBy("run_id").agg(F.collect_set(F.round("u", 6)).alias("s"))
    gone = F.array_except(F.array(*(F.lit(float(x)) for x in levels)), "s")
    return violations(seen.where(F.size(gone) > 0), "control_level_missing", F.lit(None), F.array_join(gone.cast("array<string>"), ","))


def early_effects(windows: DataFrame) -> DataFrame:
    """Windows that carry a command before it was applied, and those without any."""
    rules = F.when(F.col("applied_ns").isNull(), "window_before_first_command").when(F.col("applied_ns") > F.col("start_ns"), "effect_before_command")
    return violations(windows.withColumn("_c", rules).where("_c is not null"), F.col("_c"), F.col("window_id"), F.col("applied_ns"))


def short_dwells(windows: DataFrame, least: int) -> DataFrame:
    """Levels left after fewer than ``least`` windows, but for a run's last."""
    w = W.partitionBy("run_id").orderBy("window_id")
    part = windows.withColumn("_m", F.when(F.col("u") != F.lag("u").over(w), 1).otherwise(0)).withColumn("_s", F.sum("_m").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = part.groupBy("run_id", "_s").agg(F.count("*").alias("n"), F.min("window_id").alias("first")).withColumn("_last", F.max("_s").over(W.partitionBy("run_id")))
    return violations(g.where((F.col("n") < least) & (F.col("_s") < F.col("_last"))), "dwell_too_short", F.col("first"), F.col("n"))


def migrations(emissions: DataFrame) -> DataFrame:
    """Requests served by more than one decoder: a control change must not move them."""
    g = emissions.groupBy("run_id", "request_id").agg(F.countDistinct("component").alias("n")).where("n > 1")
    return violations(g, "decoder_migration", F.col("request_id"), F.col("n"))


def run_rules(windows: DataFrame, applied: DataFrame, fast: int, levels: list[float], least_variance: float, most_step: float, least_moves: int, least_dwell_ns: int) -> DataFrame:
    """What a control run must be to enter a dataset. windows: (run_id, window_id, u, applied_ns, command_id, source); applied: (run_id, command_id, generation).

    A run with fewer or more windows than ``fast``, levels it never visits, too little variance or too few moves, moves that are
    too large or too soon after one another, input that no command accounts for, or generations that don't rise.
    """
    w = W.partitionBy("run_id").orderBy("window_id")
    moved = windows.withColumn("_d", F.col("u") - F.lag("u").over(w)).withColumn("_m", F.abs("_d") > 1e-12)
    times = moved.where("_m").select("run_id", "window_id", (F.col("applied_ns") - F.lag("applied_ns").over(w)).alias("_t")).groupBy("run_id").agg(F.min("_t").alias("_dwell"))
    known = applied.select("run_id", "command_id").distinct().withColumn("_known", F.lit(True))
    rows = moved.join(known, ["run_id", "command_id"], "left")
    level = F.collect_set(F.round("u", 6))
    bad = F.col("u").isNull() | F.isnan("u") | (F.abs("u") == float("inf"))
    g = rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"), level.alias("seen"), F.var_pop("u").alias("var"), F.max(F.abs("_d")).alias("step"), F.count_if("_m").alias("moves"),
        F.count_if(~F.col("source").eqNullSafe(F.lit("actuator_applied"))).alias("other"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.count_if(~F.startswith(F.coalesce("command_id", F.lit("")), F.col("run_id").cast("string"))).alias("foreign"),
    ).join(times, "run_id", "left")
    wanted = F.array(*(F.lit(float(x)) for x in levels))
    rules = {
        "fast_window_count": F.col("n") != fast, "control_array_nonfinite": F.col("bad") > 0, "u_not_from_actuator_applied": F.col("other") > 0, "cross_run_control_command": F.col("foreign") > 0,
        "control_levels_incomplete": F.size(F.array_except(wanted, "seen")) > 0, "control_variance_too_low": F.coalesce("var", F.lit(0.0)) < least_variance, "control_delta_violation": F.col("step") > most_step + 1e-10,
        "insufficient_control_transitions": F.col("moves") < least_moves, "actual_dwell_too_short": F.col("_dwell") < least_dwell_ns, "u_without_actuator_event": F.col("unknown") > 0,
    }
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    out = violations(g.select("run_id", F.explode(codes).alias("c")), F.col("c"), F.lit(None), F.lit(None))
    wg = W.partitionBy("run_id").orderBy("applied_ns", "command_id")
    back = applied.select("run_id", "command_id", "generation", "applied_ns").distinct().withColumn("_b", F.lag("generation").over(wg)).where("generation <= _b").groupBy("run_id").agg(F.count("*").alias("n"))
    return out.unionByName(violations(back, "control_generation_not_strictly_monotonic", F.lit(None), F.col("n")))


def state_rules(runs: DataFrame, events: DataFrame, slow: DataFrame, writers: DataFrame, health: DataFrame, blocks: int, split: str, topology: str) -> DataFrame:
    """What must hold around a control run's signal, a violation for each code of a run.

    runs: (run_id, base_valid, drained, errors, split, topology, pod_before, pod_after, restarts_before, restarts_after); events: (run_id, event_type);
    slow: (run_id, complete: the row has all control fields); writers: (run_id, enqueued, written, dropped); health: (run_id, status).
    Each table is counted by run in one shuffle of all of them. What isn't known of a run is a violation.
    """
    count = lambda df, **of: df.select("run_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.when(c, 1).otherwise(0).alias("v")) for n, c in of.items()))).alias("x")).select("run_id", "x.*")
    is_ = lambda kind: F.col("event_type") == kind
    facts = [
        count(events, rejects=is_("actuator_rejected"), fallbacks=is_("actuator_safety_fallback")), count(slow, slow=F.lit(True), gone=~F.coalesce("complete", F.lit(False))),
        count(writers, drops=F.coalesce(F.col("dropped") != 0, F.lit(True)), unequal=~F.col("written").eqNullSafe(F.col("enqueued"))), count(health, sick=~F.col("status").eqNullSafe(F.lit(200))),
    ]
    names = ["rejects", "fallbacks", "slow", "gone", "drops", "unequal", "sick"]
    sums = reduce(DataFrame.unionByName, facts).groupBy("run_id").agg(*(F.sum(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names))
    g = runs.join(sums, "run_id", "left").fillna(0, names)
    same = lambda a, b: F.col(a).eqNullSafe(b)
    rules = {
        "base_snapshot_invalid": ~same("base_valid", F.lit(True)), "slow_window_count": F.col("slow") != blocks, "slow_control_fields_missing": F.col("gone") > 0, "control_reject_present": F.col("rejects") > 0,
        "safety_fallback_present": F.col("fallbacks") > 0, "inventory_not_drained": ~same("drained", F.lit(True)), "topology_drift": ~same("topology", F.lit(topology)), "writer_drop_nonzero": F.col("drops") > 0,
        "writer_counter_mismatch": F.col("unequal") > 0, "workload_error_present": ~same("errors", F.lit(0)), "health_sample_failure": F.col("sick") > 0, "invalid_split": ~same("split", F.lit(split)),
        "pod_uid_changed": F.col("pod_before").isNull() | ~same("pod_before", F.col("pod_after")), "pod_restart_detected": ~(same("restarts_before", F.lit(0)) & same("restarts_after", F.lit(0))),
    }
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return violations(g.select("run_id", F.explode(codes).alias("c")), F.col("c"), F.lit(None), F.lit(None))


def smoke_rules(events: DataFrame, fields: list[str], types: list[str]) -> DataFrame:
    """events: (run_id, event_type, event_seq, ts_ns, trace_id, attempt_id, decoder, command_id, applied_ns, fields: array of names present).

    Control events have all fields and all types occur; the first controlled route of a command isn't before it was applied; no attempt has two decoders.
    """
    control = F.col("event_type").isin(*types)
    gone = F.array_except(F.array(*map(F.lit, fields)), F.coalesce("fields", F.array().cast("array<string>")))
    out = violations(events.where(control).withColumn("_g", gone).where(F.size("_g") > 0), "control_field_missing", F.col("event_seq"), F.array_join(F.array_sort("_g"), ","))
    seen = events.groupBy("run_id").agg(F.collect_set(F.when(control, F.col("event_type"))).alias("s")).withColumn("_g", F.array_except(F.array(*map(F.lit, types)), "s"))
    out = out.unionByName(violations(seen.where(F.size("_g") > 0), "control_event_type_missing", F.lit(None), F.array_join(F.array_sort("_g"), ",")))
    routes = events.where("event_type = 'p_to_d_route' and command_id is not null").groupBy("run_id", "command_id").agg(F.min(F.struct("event_seq", "ts_ns")).alias("r"))
    applied = events.where("event_type = 'actuator_applied'").groupBy("run_id", "command_id").agg(F.max_by("applied_ns", "event_seq").alias("applied_ns")).join(routes, ["run_id", "command_id"], "left")
    early = F.when(F.col("r").isNull(), "no_controlled_route").when(F.col("r.ts_ns") < F.col("applied_ns"), "route_before_apply")
    out = out.unionByName(violations(applied.withColumn("_e", early).where("_e is not null"), "first_effect_before_apply", F.col("command_id"), F.col("_e")))
    moved = events.where("event_type = 'p_to_d_route'").groupBy("run_id", "trace_id", "attempt_id").agg(F.countDistinct("decoder").alias("n")).where("n <> 1")
    return out.unionByName(violations(moved, "attempt_decoder_migration", F.concat_ws("/", "trace_id", "attempt_id"), F.col("n")))
