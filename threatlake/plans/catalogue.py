"""All registered queries and their SQL."""

from __future__ import annotations

from threatlake.plans import feeds, landing, learning, policies, text  # noqa: F401  registers them
from threatlake.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
