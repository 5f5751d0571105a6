"""All registered queries of the chart engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import catalog_queries, chart_queries, notation_queries, product_queries, vector_queries

MODULES = (chart_queries, catalog_queries, vector_queries, notation_queries, product_queries)


def queries() -> dict[str, Callable]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
