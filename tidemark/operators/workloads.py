"""Generators of arrival rates and control schedules, and experiment matrices. Small, seeded, on the driver."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed(*parts: str) -> int:
    """First 8 bytes of the SHA-256 of the NUL-joined parts."""
    return int.from_bytes(hashlib.sha256("\0".join(parts).encode()).digest()[:8], "big")


#: Multiples of the average rate from each part of the duration on, and where a part's line ends.
LEVELS = {
    "poisson": ((0.0, 1.0, 1.0),),
    "step-up": ((0.0, 0.30, 0.30), (0.5, 0.85, 0.85)),
    "step-down": ((0.0, 0.85, 0.85), (0.5, 0.40, 0.40)),
    "ramp-up": ((0.0, 0.30, 0.95),),
    "held-out-composite": ((0.0, 0.90, 0.90), (1 / 3, 0.50, 0.50), (2 / 3, 0.80, 0.80)),
}


def parts(kind: str, duration: float, on: float = 5.0, off: float = 5.0, multiplier: float = 2.0) -> tuple[list[tuple[float, float, float, float]], float | None]:
    """(start, end, first level, last level) of each part, and the cycle after which they come again.

    Bursts must keep the average: multiplier * on = on + off.
    """
    if kind == "on_off_burst":
        if abs(multiplier * on - (on + off)) > 1e-9 * (on + off):
            raise ValueError("bursts don't keep the average")
        return [(0.0, on, multiplier, multiplier), (on, on + off, 0.0, 0.0)], on + off
    if kind not in LEVELS:
        raise ValueError(kind)
    starts = [s * duration for s, _, _ in LEVELS[kind]]
    return [(a, b, x, y) for a, b, (_, x, y) in zip(starts, [*starts[1:], duration], LEVELS[kind], strict=True)], None


def rate(kind: str, average: float, duration: float, **burst: float) -> Callable[[float], float]:
    """Arrivals a second at each time; before the start and after the end, the nearest level holds."""
    found, cycle = parts(kind, duration, **burst)

    def at(t: float) -> float:
        t = t % cycle if cycle else t
        a, b, x, y = next((p for p in reversed(found) if t >= p[0]), found[0])
        return average * (x + (y - x) * min(max((t - a) / (b - a), 0.0), 1.0))

    return at


def rate_column(t: Column, kind: str, average: float, duration: float, **burst: float) -> Column:
    """rate() as an expression over a column of seconds."""
    found, cycle = parts(kind, duration, **burst)
    t = F.pmod(t.cast("double"), F.lit(cycle)) if cycle else t.cast("double")
    level = lambda p: F.lit(p[2]) + (p[3] - p[2]) * F.least(F.greatest((t - p[0]) / (p[1] - p[0]), F.lit(0.0)), F.lit(1.0))
    out = level(found[0])
    for p in found[1:]:
        out = F.when(t >= p[0], level(p)).otherwise(out)
    return out * average


def arrivals(rate_at: Callable[[float], float], highest: float, duration: float, seed_: int) -> Iterator[float]:
    """Times of an inhomogeneous Poisson process, by thinning."""
    rng, t = random.Random(seed_), 0.0
    while (t := t + rng.expovariate(highest)) < duration:
        if rng.random() * highest < rate_at(t):
            yield t


def schedule(kind: str, duration: int, levels: tuple[float, ...], hold: int, seed_: int) -> list[tuple[int, float]]:
    """(second, level) of a control signal: steps through the levels, pseudo-random binary, or random dwell."""
    rng, out, t, i = random.Random(seed_), [], 0, 0
    while t < duration:
        if kind == "step":
            level, stay = levels[i % len(levels)], hold
        elif kind == "prbs":
            level, stay = rng.choice((levels[0], levels[-1])), hold
        elif kind == "random_dwell":
            level, stay = rng.choice(levels), rng.randint(hold, 3 * hold)
        else:
            raise ValueError(kind)
        out.append((t, level))
        t, i = t + stay, i + 1
    return out


def matrix(factors: dict[str, list]) -> list[dict]:
    """All combinations of the factors' values, numbered."""
    return [{"run": i, **dict(zip(factors, values, strict=True))} for i, values in enumerate(itertools.product(*factors.values()))]
