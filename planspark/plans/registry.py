"""Names of all queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its name, with the SQL of the same rows where there is one."""

    def add(query: Query) -> Query:
        _queries[name] = query
        if sql is not None:
            _sql[name] = sql
        return query

    return add


def _load() -> None:
    from planspark.plans import aggregates, assembly, extras, matching, relations, reports, scenes  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
