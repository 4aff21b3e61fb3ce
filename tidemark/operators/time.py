"""Windows, intervals, as-of and nearest joins, running sums.

Nothing here joins by range: events meet windows by integer arithmetic, intervals are put on boundaries by
a sequence or as +/- deltas, and as-of joins are one sorted pass over the union of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import boundary_at_or_after, col, window_index


def dense(df: DataFrame, keys: list[str], index: str, ranges: DataFrame, fill: dict[str, object]) -> DataFrame:
    """df with a row for each index of each key's range; ranges: (keys, lo, hi), both ends included."""
    grid = ranges.where("lo <= hi").select(*keys, F.explode(F.sequence("lo", "hi")).alias(index))
    return grid.join(df, [*keys, index], "left").fillna(fill)


def ranges_of(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, lo, hi) of an index; the whole table is one range without keys."""
    return df.groupBy(*keys).agg(F.min(index).alias("lo"), F.max(index).alias("hi"))


def on_boundaries(df: DataFrame, start: Column | str, end: Column | str, period: int, first: int, last: int, name: str = "k") -> DataFrame:
    """A row for each boundary k in [first, last] with start <= k * period < end; a null end never comes."""
    a, b = F.greatest(boundary_at_or_after(start, period), F.lit(first)), F.least(F.coalesce(boundary_at_or_after(end, period) - 1, F.lit(last)), F.lit(last))
    return df.withColumn("_a", a).withColumn("_b", b).where("_a <= _b").withColumn(name, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def inventory(df: DataFrame, keys: list[str], start: Column | str, end: Column | str, period: int, amounts: dict[str, Column]) -> DataFrame:
    """(keys, k, amounts) at each boundary where an amount changes, by deltas and a running sum: long intervals cost two rows."""
    held = df.select(*keys, boundary_at_or_after(start, period).alias("k"), boundary_at_or_after(end, period).alias("_e"), *(v.alias(n) for n, v in amounts.items())).where("k < _e or _e is null")
    moves = F.array(F.struct("k", *amounts), F.struct(F.col("_e").alias("k"), *((-F.col(n)).alias(n) for n in amounts)))
    moves = F.when(F.col("_e").isNull(), F.slice(moves, 1, 1)).otherwise(moves)
    deltas = held.select(*keys, F.inline(moves)).groupBy(*keys, "k").agg(*(F.sum(n).alias(n) for n in amounts))  # one pass: what gives df may be dear
    w = W.partitionBy(*keys).orderBy("k")
    return deltas.select(*keys, "k", *(F.sum(n).over(w).alias(n) for n in amounts))


def seen(df: DataFrame, start: str, end: str, period: int) -> DataFrame:
    """The intervals that hold a boundary: the others change no inventory at one. A null end never comes."""
    return df.where(F.col(end).isNull() | (boundary_at_or_after(start, period) < boundary_at_or_after(end, period)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], order: list[str] = (), strict: bool = False) -> DataFrame:
    """left with the values of the last right row not after (strict: before) its time; ties of right by ``order``.

    One sort of the union for each key; rows of left keep their count.
    """
    l = left.select(*(F.col(k) for k in keys), F.col(left_ts).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(_row(right, values)).alias("_right"), *(F.lit(None).cast(right.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(order)))  # noqa: E741
    r = right.select(*(F.col(k) for k in keys), F.col(right_ts).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), F.struct(*values).alias("_right"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    w = W.partitionBy(*keys).orderBy("_t", "_side", *(f"_o{i}" for i in range(len(order)))).rowsBetween(W.unboundedPreceding, 0)
    held = l.unionByName(r).withColumn("_held", F.last("_right", ignorenulls=True).over(w))
    return held.where("_left is not null").select("_left.*", *(F.col(f"_held.{v}").alias(v) for v in values))


def _row(df: DataFrame, names: list[str]):
    return df.select(F.struct(*names).alias("x")).schema["x"].dataType


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str) -> DataFrame:
    """left with ``gap``: the least distance in time to a row of right, null without one."""
    both = left.select(*keys, F.col(left_ts).alias("_t"), F.struct(*left.columns).alias("_left"), F.lit(None).cast("long").alias("_r")).unionByName(
        right.select(*keys, F.col(right_ts).alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), F.col(right_ts).alias("_r"))
    )
    # both frames only grow: one that shrinks is gone through anew for each row
    before = F.last("_r", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t").rangeBetween(W.unboundedPreceding, 0))
    after = F.last("_r", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("_t")).rangeBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_b", before).withColumn("_a", after).where("_left is not null")
    return out.select("_left.*", F.least(F.col("_t") - F.col("_b"), F.col("_a") - F.col("_t")).alias("gap"))


def running_before(df: DataFrame, keys: list[str], ts: str, amount: str) -> Column:
    """Sum of the amounts strictly before each row's time."""
    return F.coalesce(F.sum(amount).over(W.partitionBy(*keys).orderBy(ts).rangeBetween(W.unboundedPreceding, -1)), F.lit(0))


def block_sum(df: DataFrame, keys: list[str], index: str, factor: int, sums: list[str], samples: list[str] = ()) -> DataFrame:
    """Sums (and the first row's samples) of blocks of ``factor`` consecutive rows of a key; a block that isn't full is dropped."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(index)) - 1
    block = df.withColumn("_i", place).withColumn("block", window_index("_i", factor))
    out = block.groupBy(*keys, "block").agg(*(F.sum(s).alias(s) for s in sums), *(F.min_by(s, "_i").alias(s) for s in samples), F.count("*").alias("_n"))
    return out.where(F.col("_n") == factor).drop("_n")


def lagged(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """df with value_lag1.. of the same key; before the first row, the first value stands."""
    w = W.partitionBy(*keys).orderBy(order)
    first = F.first(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.select("*", *(F.coalesce(F.lag(value, i).over(w), first).alias(f"{value}_lag{i}") for i in range(1, lags + 1)))


def moving(df: DataFrame, keys: list[str], order: str, value: str, scale: int, dt: float) -> DataFrame:
    """df with the trailing mean, integral and change over ``scale`` rows of the same key."""
    w = W.partitionBy(*keys).orderBy(order)
    back = w.rowsBetween(-(scale - 1), 0)
    first = F.first(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.select("*", F.avg(value).over(back).alias(f"mean_{scale}"), (F.sum(value).over(back) * dt).alias(f"integral_{scale}"), (F.col(value) - F.coalesce(F.lag(value, scale).over(w), first)).alias(f"change_{scale}"))


def scan(df: DataFrame, keys: list[str], order: str, decay: Column | float, value: Column, name: str) -> DataFrame:
    """df with m = decay * (m of the row before) + value along each key; decay is one number of a key, 0 to 1.

    Rows are dealt to blocks over which the decay falls by a factor of e**100. Within a block the sum is a running
    one of values scaled to the block's start; of the blocks before only the last two can matter. No list is built.
    """
    rate = -F.log(F.greatest(col(decay) if isinstance(decay, (Column, str)) else F.lit(float(decay)), F.lit(1e-40)))
    length = F.when(rate > 0, F.greatest(F.floor(F.lit(100.0) / rate), F.lit(1))).otherwise(F.lit(1 << 40))
    w = W.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_v", value.cast("double")).withColumn("_r", rate).withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_i") / length)).withColumn("_j", F.col("_i") - F.col("_b") * length)
    block = W.partitionBy(*keys, "_b")
    inside = F.exp(-F.col("_r") * F.col("_j")) * F.sum(F.col("_v") * F.exp(F.col("_r") * F.col("_j"))).over(block.orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_m", inside)
    ends = rows.groupBy(*keys, "_b").agg(F.max_by("_m", "_i").alias("_e"), F.count("*").alias("_n"), F.first("_r").alias("_q"))
    wb = W.partitionBy(*keys).orderBy("_b")
    before = F.coalesce(F.lag("_e").over(wb), F.lit(0.0)) + F.coalesce(F.lag("_e", 2).over(wb) * F.exp(-F.col("_q") * F.lag("_n").over(wb)), F.lit(0.0))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), before.alias("_before"))
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ends, same, "left").withColumn(name, F.col("_m") + F.coalesce("_before", F.lit(0.0)) * F.exp(-F.col("_r") * (F.col("_j") + 1))).select(*df.columns, name)


def ewma(df: DataFrame, keys: list[str], order: str, value: str, tau: int, name: str = "memory") -> DataFrame:
    """df with the exponential memory before each row's update, seeded with the key's first value: m' = a m + (1 - a) x."""
    a = 2.718281828459045 ** (-1.0 / tau)
    x = F.col(value).cast("double")
    fed = df.withColumn("_x", F.coalesce(F.lag(x).over(W.partitionBy(*keys).orderBy(order)) * (1 - a), x))
    return scan(fed, keys, order, a, F.col("_x"), name).drop("_x")


def dense_inventory(df: DataFrame, keys: list[str], start: Column | str, end: Column | str, period: int, amounts: dict[str, Column], last: int | Column) -> DataFrame:
    """inventory() at every boundary up to ``last`` at which an amount isn't 0: unfolded after aggregation, a row for each group and boundary."""
    found = inventory(df, keys, start, end, period, amounts)
    end = F.lit(last) if isinstance(last, int) else last
    until = F.least(F.lead("k").over(W.partitionBy(*keys).orderBy("k")) - 1, end)  # a null of the last change gives way
    held = found.withColumn("_z", until).where(" or ".join(f"{n} <> 0" for n in amounts)).where("k <= _z")
    return held.withColumn("k", F.explode(F.sequence("k", "_z"))).drop("_z")


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): the union of each key's intervals; a null end never comes."""
    w = W.partitionBy(*keys).orderBy(start)
    never = F.lit((1 << 63) - 1)
    rows = df.select(*keys, F.col(start).alias("_s"), F.coalesce(end, never).alias("_e"))
    w = W.partitionBy(*keys).orderBy("_s", "_e")
    new = F.when(F.col("_s") > F.max("_e").over(w.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)
    part = rows.withColumn("_n", new).withColumn("_p", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return part.groupBy(*keys, "_p").agg(F.min("_s").alias(start), F.max("_e").alias("_e")).select(*keys, start, F.nullif(F.col("_e"), never).alias(end))


def by_age(df: DataFrame, anchor: str, start: str, end: str, edges: list[int | None], name: str = "bin") -> DataFrame:
    """Each interval cut at ``anchor`` + edges (the first edge and what lies below it is bin 0, a null last edge never comes): one row for each bin it meets."""
    cuts = [None, *edges[1:-1], None]
    at = lambda e: F.lit(None).cast("long") if e is None else F.col(anchor) + F.lit(e).cast("long")
    pieces = F.array(*(F.struct(F.lit(i).alias("b"), F.greatest(F.col(start), at(a)).alias("s"), F.least(F.col(end), at(b)).alias("e")) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))))
    cut = df.withColumn("_x", F.explode(pieces)).where("_x.e is null or _x.s < _x.e")
    return cut.withColumn(start, F.col("_x.s")).withColumn(end, F.col("_x.e")).withColumn(name, F.col("_x.b")).drop("_x")


def cross_correlation(df: DataFrame, keys: list[str], order: str, x: str, y: str, lags: int) -> DataFrame:
    """(keys, lag, n, corr) of x at a row with y ``lag`` rows later."""
    w = W.partitionBy(*keys).orderBy(order)
    pairs = df.select(*keys, F.col(x).cast("double").alias("x"), *(F.lead(F.col(y).cast("double"), i).over(w).alias(f"_y{i}") for i in range(lags + 1)))
    long = pairs.select(*keys, "x", F.posexplode(F.array(*(F.col(f"_y{i}") for i in range(lags + 1)))).alias("lag", "y")).where("x is not null and y is not null")
    return long.groupBy(*keys, F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr"))


def lag_of_best(df: DataFrame, keys: list[str], order: str, x: str, y: str, lags: int) -> DataFrame:
    """(keys, lag, corr): of the lags -lags to lags the one at which x and y, ``lag`` rows later, correlate most (in absolute value; ties: the nearest to 0, then the lesser)."""
    w = W.partitionBy(*keys).orderBy(order)
    shifts = list(range(-lags, lags + 1))
    wide = df.select(*keys, F.col(x).cast("double").alias("x"), F.array(*(F.struct(F.lit(i).alias("lag"), F.lead(F.col(y).cast("double"), i).over(w).alias("y")) for i in shifts)).alias("_a"))
    pairs = wide.select(*keys, "x", F.explode("_a").alias("z"))
    long = pairs.select(*keys, "x", "z.lag", "z.y").where("x is not null and y is not null")
    found = long.groupBy(*keys, "lag").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr")).where("corr is not null")
    best = found.groupBy(*keys).agg(F.min(F.struct((-F.round(F.abs("corr"), 9)).alias("a"), F.abs("lag").alias("b"), "lag", "corr")).alias("z"))
    return best.select(*keys, "z.lag", "z.corr")


def changes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with ``segment``: how often the value has changed before or at the row."""
    w = W.partitionBy(*keys).orderBy(order)
    moved = F.when(col(value) != F.lag(value).over(w), 1).otherwise(0)
    return df.withColumn("_m", moved).withColumn("segment", F.sum("_m").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_m")
