"""All queries of the episode-analytics part, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.sources.proxies import SQL as VIEWS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Registers a query; views: its SQL reads the episode views."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = VIEWS + sql if views else sql
        return f

    return add


def _load() -> None:
    from spanforge.plans import aggregates, files, images, intervals, relations, requests, rewriting, sequences, streams, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
