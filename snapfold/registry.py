"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query under a name, with its SQL if there is any."""

    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add
