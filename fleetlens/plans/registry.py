"""Queries bound to the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``; without ``sql`` only its rows are checked."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register
