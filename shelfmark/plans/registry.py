"""Registration of queries next to their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans.bind import Library, views_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``build(library)`` under ``name``; ``sql`` states the same result for DuckDB."""

    def register(build):
        QUERIES[name] = lambda spark, folder: build(Library(spark, folder))
        if sql is not None:
            ORACLE[name] = views_sql(sql, views)
        return build

    return register
