"""Queries over the driver's tables, each beside its SQL twin.

The tables play the parts of legislative records: orders are bills, line items and events their logs, nations
the states, conversations run logs, documents and pages the texts, embeddings the vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if SQL can express it, the twin."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def all_queries() -> dict[str, Query]:
    from lawmill import queries_core, queries_health, queries_records, queries_runs, queries_text  # noqa: F401  registers

    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(SQL)
