"""What the operators share: reading tables, and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, fresh_folder, own_folder

#: Bytes that a broadcast may have, by the measure of ``checked_broadcast``.
BROADCAST_BYTES = 16 << 20
#: The paths of each ``scratch`` around, for each thread apart, as two queries may run side by side.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in this application's part of the shared folder that nothing else uses."""
    path = fresh_folder(spark, label)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once, stored as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what lies before. The table goes at the end of the
    innermost ``scratch`` around it, else when the application ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``written`` and ``fresh_path`` left within it; frames of these can't be read after."""
    mine: list[str] = []
    before = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in mine:
            delete(spark, path)


def keep(spark: SparkSession, label: str) -> str:
    """A fresh path that outlives the innermost ``scratch``."""
    before = _scopes.set(_scopes.get()[:-1])
    try:
        return fresh_path(spark, label)
    finally:
        _scopes.reset(before)


def checked_broadcast(df: DataFrame, width=None) -> DataFrame:
    """``df`` to be broadcast if its rows' widths (bytes; by default 64 a row) add up to BROADCAST_BYTES at most; else as it is, joined by a shuffle."""
    size = df.agg(F.coalesce(F.sum(F.lit(64) if width is None else width), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def forget(spark: SparkSession) -> None:
    """Deletes all that this application has left in the shared folder; no frame of it can be read after."""
    delete(spark, own_folder(spark))
