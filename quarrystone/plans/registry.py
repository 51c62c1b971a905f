"""Where queries are registered: a name, a function of the archive, and DuckDB SQL if SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Archive, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of an ``Archive`` under its own name."""

    def register(f: Callable[[Archive], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Archive(spark, folder))
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register
