"""Named queries, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
PLANS = ("scans", "joins", "aggregates", "windows", "scalars", "domain", "users", "reports", "more", "market", "state", "sinks", "pairs", "rest", "topics", "digests", "streams", "events", "forecasts", "baselines")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with SQL that returns the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def sql_of(name: str) -> str:
    """SQL of a query that is already registered, for SQL that builds on it."""
    return _SQL[name]


def _load() -> None:
    for m in PLANS:
        importlib.import_module(f"sigmill.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
