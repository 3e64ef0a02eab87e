"""The registered queries of the match-tracking engine and their SQL."""

from __future__ import annotations

from .plans.catalog_queries import QUERIES
from .plans.catalog_sql import SQL
from .plans.views import oracle


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: oracle(v) for k, v in SQL.items()}
