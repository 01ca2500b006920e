"""All queries of the core and their SQL."""

from __future__ import annotations

from . import graph_queries, model_queries, search_queries, text_queries, units_queries, upkeep_queries

_MODULES = (units_queries, graph_queries, text_queries, search_queries, upkeep_queries, model_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.oracle_sql().items()}
