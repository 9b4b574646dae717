"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..oracle_views import complete

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin with the views it names filled in."""
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = complete(sql)
        return fn
    return register
