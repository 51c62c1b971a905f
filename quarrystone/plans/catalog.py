"""All of the library's own queries by name, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, files, integrity, jobs, localise, pages, preservation, replay, storage, streams, upkeep, urls  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
