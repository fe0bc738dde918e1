"""Queries of this subpackage and their SQL; filled by the modules of the operators."""

from __future__ import annotations

from millrace.plans.catalog.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, table folder) -> DataFrame with its SQL equivalent."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


__all__ = ["ORACLES", "QUERIES", "query", "table"]
