"""The registered queries of the vocabulary and corpus operators, and their SQL."""

from __future__ import annotations

from lexiforge.plans.queries import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
