"""Column expressions that Spark lacks by name. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a UUID anywhere in a text.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
DAY_NS = 86_400_000_000_000


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_ns(ts: str) -> Column:
    """Nanoseconds since 1970 of a timestamp column without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") * F.lit(1000).cast("long")


def window_index(ts: Column | str, period: int, start: int = 0) -> Column:
    """Number of the half-open window [start + k * period, ...) that holds ts; exact, for times before start too."""
    shifted = col(ts) - F.lit(start).cast("long")
    return _div(shifted - F.pmod(shifted, F.lit(period).cast("long")), period)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def boundary_at_or_after(ts: Column | str, period: int) -> Column:
    """Number of the first boundary k * period that isn't before ts: what happens on a boundary shows there."""
    return -window_index(-col(ts), period)


def boundary_after(ts: Column | str, period: int) -> Column:
    """Number of the first boundary strictly after ts: an emission on a boundary shows only at the next one."""
    return window_index(ts, period) + 1


def bin_irregular(value: Column | str, edges: Sequence[float]) -> Column:
    """Number of the half-open bin [e_i, e_i+1); what lies in none (below the first edge, NaN) goes to the last bin."""
    v, last = col(value), len(edges) - 2
    found = sum((F.when(v >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(v.isNull(), None).when(F.isnan(v.cast("double")) | (v < edges[0]), last).otherwise(found)


def bin_equal(value: Column | str, most: int, width: int) -> Column:
    """Bin of equal width, values outside clamped to the ends; null stays null."""
    v = col(value).cast("long")
    return F.least(_div(F.greatest(v, F.lit(0).cast("long")), width), F.lit(most // width).cast("long")).cast("int")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def or_else(a: Column | str, b: Column | str) -> Column:
    """a, but b where a is null or 0."""
    return F.coalesce(F.nullif(col(a), F.lit(0)), col(b))


def side_of(endpoint: Column | str) -> Column:
    """0 or 1 by the decoder's port, else null."""
    return F.when(F.endswith(col(endpoint), F.lit(":13701")), 0).when(F.endswith(col(endpoint), F.lit(":13702")), 1)


def signed(total: Column | str, a: Column | str) -> Column:
    """A minus B, given A and the total."""
    return 2 * col(a) - col(total)


def seed_of(*parts: Column) -> Column:
    """First 8 bytes of the SHA-256 of the NUL-joined parts, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def phase_features(ts: Column | str, period: int, load: Column | str) -> list[Column]:
    """phase in the period, its sine and cosine, and log1p of a load."""
    phase = F.pmod(col(ts), F.lit(period).cast("long")).cast("double") / period
    turn = phase * (2 * 3.141592653589793)
    return [phase.alias("phase"), F.sin(turn).alias("phase_sin"), F.cos(turn).alias("phase_cos"), F.log1p(col(load).cast("double")).alias("log_load")]
