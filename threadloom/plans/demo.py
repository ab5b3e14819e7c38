"""All queries over the driver tables."""

from __future__ import annotations

from threadloom.plans import aggregates, catalog, evidence, facts, history, joins, reports, search, transforms  # noqa: F401  they register their queries
from threadloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
