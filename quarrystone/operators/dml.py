"""Writes as new versions of tables: upserts, ignored inserts, deletions, re-elections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys; the rest is inserted."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What an insert adds that ignores known keys; of several new rows the first counts."""
    others = [c for c in new.columns if c not in keys]
    fresh = new.join(old.select(*keys), keys, "left_anti")
    one = fresh.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return one.select(*keys, "_r.*").select(*new.columns)


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, action: insert, update or delete, comparing whole rows by a digest; unchanged rows are left out."""
    image = lambda d, name: d.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in d.columns if c != key))), 256).alias(name))
    both = image(old, "a").join(image(new, "b"), key, "full")
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return both.select(key, action.alias("action")).where("action is not null")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A whole table replaced by way of its differences: rows that didn't change stay as they are, others are deleted, inserted or updated."""
    changes = diff(old, new, key)
    stay = old.join(changes.select(key), key, "left_anti").select(*old.columns)
    return stay.unionByName(new.join(changes.where("action <> 'delete'").select(key), key, "left_semi").select(*old.columns))


def cascade(parents: DataFrame, children: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """The children whose parents are left."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def after_delete(snapshots: DataFrame, deleted: DataFrame) -> DataFrame:
    """run_id, entry_id, pages of the runs that keep a page once ``deleted`` (id) are gone; empty runs drop out."""
    left = snapshots.join(deleted.select("id"), "id", "left_anti")
    return left.groupBy("run_id").agg(F.min("id").alias("entry_id"), F.count("*").alias("pages"))


def invalid_records(rows: DataFrame, key: str) -> DataFrame:
    """key, problem: null and repeated keys."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.where((F.col("n") > 1) | F.col(key).isNull()).select(key, F.when(F.col(key).isNull(), "null").otherwise("repeated").alias("problem"))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: str = "id") -> DataFrame:
    """Parents with an array of their children by ``order``; an empty one where there are none."""
    fields = [order, *(c for c in children.columns if c not in (key, order))]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, parents["id"] == lists[key], "left").select(parents["*"], F.coalesce(F.col(name), F.expr("array()").cast(lists.schema[name].dataType)).alias(name))
