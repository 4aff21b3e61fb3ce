"""Percentiles in three conventions, effect sizes, level and step analyses, association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, ratio


def finite(x: Column | str) -> Column:
    """The value; null instead of NaN and infinities."""
    v = col(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def pct_floor(x: Column | str, q: float) -> Column:
    """Aggregate: the sorted value at place floor((n - 1) q); null without values."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor((F.count(x) - 1) * q) + 1).cast("int"))


def pct_linear(x: Column | str, q: float) -> Column:
    """Aggregate: linear interpolation between neighbours; exact, for groups of bounded size (see percentiles() for others)."""
    return F.percentile(col(x), F.lit(q))


def pct_floor_by(df: DataFrame, keys: list[str], value: str, qs: list[float], names: list[str]) -> DataFrame:
    """(keys, names): sorted values at places floor((n - 1) q), from counts of distinct values in order; equal values are counted before the shuffle."""
    counts = df.where(col(value).isNotNull()).groupBy(*keys, col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    upto = counts.withColumn("_u", F.sum("_c").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    return upto.groupBy(*keys).agg(*(F.min(F.when(F.col("_u") > F.floor((F.col("_n") - 1) * q), F.col("_v"))).alias(n) for q, n in zip(qs, names, strict=True)))


def percentiles(df: DataFrame, keys: list[str], value: Column | str, qs: dict[str, float]) -> DataFrame:
    """(keys, a column for each of qs): linearly interpolated percentiles, from counts of distinct values in order.

    Equal values are counted before the shuffle; a group's distinct values are sorted, which can spill, never held.
    A group without values gives nulls.
    """
    counts = df.groupBy(*keys, col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    present = F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(F.lit(0))
    w = W.partitionBy(*keys)
    upto = F.sum(present).over(w.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("_u", upto).withColumn("_n", F.sum(present).over(w))
    aggregates = []
    for i, q in enumerate(qs.values()):
        at = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        inside = lambda x: F.max(F.when((F.col("_u") > x) & (F.col("_u") - F.col("_c") <= x) & F.col("_v").isNotNull(), F.col("_v")))
        aggregates += [inside(low).alias(f"_a{i}"), inside(high).alias(f"_b{i}"), F.max(at - low).alias(f"_f{i}")]
    g = placed.groupBy(*keys).agg(*aggregates)
    return g.select(*keys, *((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(qs)))


def joined_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables with one row for each key, null keys among them, side by side."""
    if not keys:
        return left.crossJoin(right)  # one row each
    other = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = F.col(keys[0]).eqNullSafe(F.col("_k0"))
    for i, k in enumerate(keys[1:], 1):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(other, same).drop(*(f"_k{i}" for i in range(len(keys))))


def bundle(df: DataFrame, keys: list[str], value: Column | str, digits: int = 3) -> DataFrame:
    """(keys, n, avg, p50, p90, p95, p99, max) of the finite values, rounded half to even."""
    v = finite(value)
    rows = df.select(*keys, v.alias("_x"))
    plain = rows.groupBy(*keys).agg(F.count("_x").alias("n"), F.bround(F.avg("_x"), digits).alias("avg"), F.bround(F.max("_x"), digits).alias("max"))
    names = {f"p{int(q * 100)}": q for q in (0.5, 0.9, 0.95, 0.99)}
    found = percentiles(rows, keys, "_x", names)
    return joined_by(plain, found.select(*keys, *(F.bround(n, digits).alias(n) for n in names)), keys)


def cohen_d(df: DataFrame, keys: list[str], level: str, value: str, low: object, high: object, pooled: bool = True, least: int = 2) -> DataFrame:
    """(keys, n_low, n_high, effect): mean difference over the standard deviation (sample variances), pooled by size or averaged."""
    at = lambda f, v: f(F.when(F.col(level) == F.lit(v), F.col(value)))
    g = df.groupBy(*keys).agg(at(F.count, low).alias("n_low"), at(F.count, high).alias("n_high"), at(F.avg, low).alias("_ml"), at(F.avg, high).alias("_mh"), at(F.var_samp, low).alias("_vl"), at(F.var_samp, high).alias("_vh"))
    n1, n2 = F.col("n_low"), F.col("n_high")
    var = F.try_divide((n1 - 1) * F.col("_vl") + (n2 - 1) * F.col("_vh"), (n1 + n2 - 2).cast("double")) if pooled else (F.col("_vl") + F.col("_vh")) / 2
    effect = F.when((n1 >= least) & (n2 >= least) & (var > 0), (F.col("_mh") - F.col("_ml")) / F.sqrt(var))
    return g.select(*keys, "n_low", "n_high", effect.alias("effect"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation; null where a side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    spread = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.stddev_pop(a) * F.stddev_pop(b))
    return F.try_divide(F.covar_pop(a, b), spread)


def steps(df: DataFrame, keys: list[str], order: str, u: str, signal: str, after: int = 13, dt: float = 5.0) -> DataFrame:
    """A row for each change of u from a key's third row on: baseline, plateau, amplitude, direction, response delay.

    Baseline: mean of the two values before; plateau: mean of the last three of the values that follow, up
    to the next change or ``after`` rows. The delay ends at the first value a fifth of the way.
    """
    w = W.partitionBy(*keys).orderBy(order)
    place = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_old", F.lag(u).over(w)).withColumn("_b", F.avg(finite(signal)).over(w.rowsBetween(-2, -1)))
    moved = F.abs(F.col(u) - F.col("_old")) > 1e-12
    marked = place.withColumn("_c", F.when(moved, F.col("_i"))).withColumn("_seg", F.last("_c", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_seg is not null")
    s = W.partitionBy(*keys, "_seg").orderBy("_i")
    part = marked.withColumn("_k", F.row_number().over(s) - 1).where(F.col("_k") < after)
    listed = part.groupBy(*keys, F.col("_seg").alias("at")).agg(
        F.min_by("_old", "_k").alias("old_u"), F.min_by(u, "_k").alias("new_u"), F.min_by("_b", "_k").alias("baseline"), F.sort_array(F.collect_list(F.struct("_k", finite(signal).alias("v")))).alias("_v")
    )
    values = F.transform(F.filter("_v", lambda x: x["v"].isNotNull()), lambda x: x["v"])
    listed = listed.withColumn("_f", values).where((F.col("at") >= 2) & F.col("baseline").isNotNull() & (F.size("_f") >= 2))
    tail = F.slice("_f", F.greatest(F.size("_f") - 2, F.lit(1)), F.lit(3))
    listed = listed.withColumn("plateau", F.aggregate(tail, F.lit(0.0), lambda a, b: a + b) / F.size(tail)).withColumn("amplitude", F.col("plateau") - F.col("baseline"))
    reach = F.filter("_v", lambda x: x["v"].isNotNull() & ((x["v"] - (F.col("baseline") + 0.2 * F.col("amplitude"))) * F.col("amplitude") >= 0))
    tolerance = F.greatest(F.abs("amplitude") * 0.2, F.lit(1e-9))
    settled = F.filter(F.sequence(F.lit(0), F.size("_f") - 2), lambda o: F.forall(F.slice("_f", o + 1, F.size("_f")), lambda x: F.abs(x - F.col("plateau")) <= tolerance))
    moves = F.abs("amplitude") > 1e-12
    return listed.select(
        *keys, F.col("at").cast("long").alias("at"), "old_u", "new_u", "baseline", "plateau", "amplitude", (F.col("amplitude") * F.signum(F.col("new_u") - F.col("old_u")) > 0).alias("direction_correct"),
        F.when(moves, F.get(reach, F.lit(0))["_k"] * dt).alias("response_delay"), F.when(moves, F.get(settled, F.lit(0)) * dt).alias("settling_time"),
    )


def stratified_median(df: DataFrame, value: str, levels: list[list[str]]) -> DataFrame:
    """(all key columns, level, median) for each key set, the most specific first; absent keys are null.

    Each level counts equal values before its shuffle.
    """
    keys = list(dict.fromkeys(k for ks in levels for k in ks))
    out: DataFrame | None = None
    for i, ks in enumerate(levels):
        found = percentiles(df, ks, value, {"median": 0.5})
        absent = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys if k not in ks]
        part = found.select(*ks, *absent, F.lit(i).alias("level"), "median").select(*keys, "level", "median")
        out = part if out is None else out.unionByName(part)
    return out


def with_fallback(df: DataFrame, medians: DataFrame, levels: list[list[str]], name: str = "predicted") -> DataFrame:
    """df with the median of the most specific key set that has one."""
    found = []
    for i, ks in enumerate(levels):
        part = medians.where(F.col("level") == i).select(*ks, F.col("median").alias(f"_m{i}"))
        df = df.join(part, ks, "left") if ks else df.crossJoin(F.broadcast(part))  # one row: the overall median
        found.append(f"_m{i}")
    return df.withColumn(name, F.coalesce(*found)).drop(*found)


def nrmse(actual: Column, predicted: Column) -> Column:
    """Aggregate: root of summed squared errors over summed squares."""
    e = actual - predicted
    return F.sqrt(F.sum(e * e) / F.greatest(F.sum(actual * actual), F.lit(1e-30)))


def share(condition: Column) -> Column:
    """Aggregate: share of rows for which the condition holds; null without rows."""
    return ratio(F.count_if(condition), F.count("*"))
