"""Queries of this subpackage and, where SQL can say the same, their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict, dict]:
    """All queries of the subpackage and their SQL."""
    from tidewatch.llm import audit_queries, queries  # noqa: F401

    return dict(QUERIES), dict(SQL)
