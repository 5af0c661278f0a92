"""Named queries of the library over the driver's tables, and their SQL counterparts."""

from __future__ import annotations

from . import bin_queries, cube_queries, table_queries

_PARTS = (bin_queries, table_queries, cube_queries)


def queries() -> dict:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
