"""All named queries, and the SQL that checks them."""

from __future__ import annotations

from quernstone.plans import evaluation_queries, index_queries, registry, search_queries, store_queries, text_queries  # noqa: F401
from quernstone.plans.registry import Query


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
