"""All queries of the engine."""

from __future__ import annotations

from . import catalog_queries, scalar_queries, search_queries, vector_queries  # noqa: F401  they register themselves
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
