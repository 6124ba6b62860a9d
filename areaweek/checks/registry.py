"""Names of checks, their Spark side and, where SQL can say it, their SQL side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__.removesuffix("_check")
        if key in QUERIES:
            raise ValueError(f"check registered twice: {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add
