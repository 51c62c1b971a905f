"""Joins that any share of the rows may have in one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt to.
SALTS = 16

#: Rows of a task where rows are dealt by their number.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, *keys: str, each: int = TASK_ROWS) -> DataFrame:
    """``rows`` dealt by ``keys`` to so many tasks that a task gets about ``each``, however many rows there are; what they are joined with by these keys follows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), *keys)


def lookup(rows: DataFrame, known: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``known``, whose keys are unique; rows without a match keep nulls.

    Rows of one key are dealt to ``salts`` tasks, and ``known`` goes to each of these; so its rows should be narrow. Where it turns out small at run time,
    Spark broadcasts it instead.
    """
    dealt = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", salt).join(dealt, [*keys, "_salt"], "left").drop("_salt")
