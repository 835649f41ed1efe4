"""The registered reference queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the DuckDB SQL for the same rows."""

    def add(run: Query) -> Query:
        key = name or run.__name__
        _QUERIES[key] = run
        if sql:
            _SQL[key] = sql
        return run

    return add


def _load() -> None:
    from . import classifying, concentrating, ensembling, linking, naming, people, recording, shaping  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
