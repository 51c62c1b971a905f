"""Comparison of two captures by keys: added, removed, changed, unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import replay_link_key

#: Keys of each kind of change that are listed; counts are whole.
LISTED = 100


def page_digest(digest: Column, size: Column) -> Column:
    """An empty body counts as missing."""
    return F.when((size > 0) & digest.isNotNull(), digest).otherwise(F.concat(F.lit("missing:"), F.coalesce(size, F.lit(0)).cast("string")))


def keyed(rows: DataFrame, key: Column, digest: Column, order: str = "id") -> DataFrame:
    """key, digest; of rows with the same key the last counts."""
    return rows.select(key.alias("key"), digest.alias("digest"), F.col(order).alias("o")).groupBy("key").agg(F.max_by("digest", "o").alias("digest"))


def changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, change, from two frames of key and digest, null-safe."""
    a, b = left.select("key", F.col("digest").alias("a"), F.lit(True).alias("in_a")), right.select("key", F.col("digest").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, "key", "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return both.select("key", change.alias("change"))


def compare_runs(snapshots: DataFrame, left: str, right: str) -> DataFrame:
    one = lambda run: keyed(snapshots.where(F.col("run_id") == run), replay_link_key(F.col("source_url")), page_digest(F.col("digest"), F.col("bytes")))
    return changes(one(left), one(right))


def listed(rows: DataFrame, most: int = LISTED) -> DataFrame:
    """The first keys of each change, with the count of all."""
    counts = rows.groupBy("change").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("change").orderBy("key"))).where(F.col("rank") <= most)
    return ranked.join(counts, "change")


def page_map(snapshots: DataFrame) -> DataFrame:
    """run_id, key, snapshot_id: stored pages by link key of source and final address, the last one wins."""
    both = snapshots.select("run_id", "id", F.posexplode(F.array("source_url", "final_url")).alias("pos", "url"))
    return both.groupBy("run_id", replay_link_key(F.col("url")).alias("key")).agg(F.max_by("id", F.struct("id", "pos")).alias("snapshot_id"))
