"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fleetlens.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None):
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register
