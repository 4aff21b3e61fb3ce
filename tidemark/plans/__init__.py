"""Registered queries, bound to the supplied tables."""

from __future__ import annotations

from tidemark.plans import events, models, replays, rules, vectors, windows  # noqa: F401  they register their queries
from tidemark.plans.registry import ORACLES, QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
