"""Every query by name, with the SQL that states the same result."""

from __future__ import annotations

from loomspark.plans import etl_queries, series_queries, subgraph_queries

_MODULES = (series_queries, subgraph_queries, etl_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
