"""Records, health, repairs: projections of overflow, duplicate ids, diagnostics, asset lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import asset_kind, asset_number

#: Diagnostic items that are kept, and their fields.
ITEMS = 120


def overflow(json: Column, field: str, kind: str) -> Column:
    """A field of the overflow attributes; null if it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{field}", kind)


def restored(rows: DataFrame, json: str, fields: dict[str, str]) -> DataFrame:
    """Rows with overflow fields over fixed columns of the same name."""
    new = {f: F.coalesce(overflow(F.col(json), f, k), F.col(f)) if f in rows.columns else overflow(F.col(json), f, k) for f, k in fields.items()}
    return rows.withColumns(new)


def job_records(jobs: DataFrame, parameters: str) -> DataFrame:
    """Jobs as records: the parameters' JSON (schema ``parameters``) decoded, flags as booleans, all other columns as they are."""
    known = [c for c in jobs.columns if c not in ("parameters_json", "auto_resume_pending")]
    return jobs.select(*known, F.from_json("parameters_json", parameters).alias("parameters"), (F.col("auto_resume_pending") != 0).alias("auto_resume_pending"))


def run_records(runs: DataFrame) -> DataFrame:
    """Runs with ``extra_json`` decoded as ``extra``; none means an empty object."""
    return runs.withColumn("extra", F.parse_json(F.coalesce("extra_json", F.lit("{}")))).drop("extra_json")


def renumbered(assets: DataFrame) -> DataFrame:
    """``new_id``: of assets of a snapshot that share an id the first keeps it, the others get the next free numbers."""
    same = Window.partitionBy("snapshot_id", "asset_id").orderBy("id")
    placed = assets.withColumn("again", F.row_number().over(same) > 1)
    top = placed.groupBy("snapshot_id").agg(F.coalesce(F.max(asset_number(F.col("asset_id"))), F.lit(0)).alias("top"))
    order = Window.partitionBy("snapshot_id", "again").orderBy("id")
    numbered = placed.withColumn("n", F.row_number().over(order)).join(top, "snapshot_id")
    fresh = F.concat(F.lit("asset_"), F.when(F.col("top") + F.col("n") < 1000, F.lpad((F.col("top") + F.col("n")).cast("string"), 3, "0")).otherwise((F.col("top") + F.col("n")).cast("string")))
    return numbered.withColumn("new_id", F.when(F.col("again"), fresh).otherwise(F.col("asset_id"))).drop("again", "n", "top")


def preferred(assets: DataFrame) -> DataFrame:
    """The id that a reference of each kind means, where an old id stands for several assets."""
    return renumbered(assets).groupBy("snapshot_id", "asset_id", asset_kind(F.col("content_type")).alias("kind")).agg(F.min_by("new_id", "id").alias("means"))


def asset_lookup(assets: DataFrame) -> DataFrame:
    """snapshot_id, url, asset_id: assets by source address, then by final address, which wins; of several the last."""
    both = assets.select("snapshot_id", "id", F.posexplode(F.array("source_url", "final_url")).alias("pos", "url")).where("url is not null")
    return both.groupBy("snapshot_id", "url").agg(F.max_by("id", F.struct("pos", "id")).alias("asset_id"))


def lightest_stylesheet(assets: DataFrame) -> DataFrame:
    """snapshot_id, id of the stylesheet with the fewest references, the first of several."""
    n = F.regexp_count(F.col("body"), F.lit(r"(?i)url\("))
    return assets.where(F.lower("content_type").contains("text/css")).groupBy("snapshot_id").agg(F.min_by("id", F.struct(n, F.col("id"))).alias("id"))


def merged_counts(a: Column, b: Column) -> Column:
    """Sums of two maps of counts; negative ones count as nothing."""
    plus = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    return F.map_zip_with(a, b, lambda _, x, y: plus(x) + plus(y))


def merged_items(a: Column, b: Column) -> tuple[Column, Column]:
    """The first ITEMS of both lists, and how many were cut off."""
    every = F.concat(a, b)
    return F.slice(every, 1, ITEMS), F.greatest(F.size(every) - ITEMS, F.lit(0))


def merged_records(rows: DataFrame, key: str, part: str, kind: str, item: str) -> DataFrame:
    """key, counts (by kind), items, cut: the records of a key's two parts (``part`` false, then true) merged into one.

    Only a part's first ITEMS items are ever gathered, by a window that is cut in every task, so a key may
    hold any share of the rows.
    """
    first = Window.partitionBy(key, part).orderBy(item)
    kept = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= ITEMS)
    lists = kept.groupBy(key, part).agg(F.sort_array(F.collect_list(item)).alias("items"))
    tallies = rows.groupBy(key, part, kind).count().groupBy(key, part).agg(F.map_from_entries(F.collect_list(F.struct(kind, "count"))).alias("counts"), F.sum("count").alias("n"))
    record = tallies.join(lists, [key, part])
    side = lambda late: record.where(F.col(part) == late).select(key, *(F.col(c).alias(f"{c}{int(late)}") for c in ("counts", "items", "n")))
    both = side(False).join(side(True), key, "full")
    none = lambda c, like: F.coalesce(c, F.filter(like, lambda x: F.lit(False)))
    no_counts = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    items, _ = merged_items(none(F.col("items0"), F.col("items1")), none(F.col("items1"), F.col("items0")))
    total = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
    counts = merged_counts(F.coalesce("counts0", no_counts), F.coalesce("counts1", no_counts))
    return both.select(key, counts.alias("counts"), items.alias("items"), F.greatest(total - ITEMS, F.lit(0)).cast("long").alias("cut"))


def storage_health(jobs: DataFrame, snapshots: DataFrame, users: DataFrame) -> DataFrame:
    """One row: jobs, runs, whether anything is set up, whether registration is open."""
    runs = snapshots.agg(F.countDistinct("run_id").alias("runs"))
    return jobs.agg(F.count("*").alias("jobs")).crossJoin(runs).crossJoin(users.agg((F.count("*") > 0).alias("set_up"), (F.count("*") == 0).alias("open")))  # single rows


def emptiness(*tables: DataFrame) -> DataFrame:
    """One row: rows of all tables together."""
    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.agg(F.sum("n").alias("rows"))


def required_bytes(assets: DataFrame) -> DataFrame:
    """snapshot_id, bytes: counted for each reference, not for each unique body."""
    size = assets.groupBy("digest").agg(F.max("bytes").alias("b"))
    return assets.select("snapshot_id", "digest").join(size, "digest").groupBy("snapshot_id").agg(F.sum("b").alias("bytes"))


def deeper(snapshots: DataFrame, depth: Column, most: Column) -> DataFrame:
    """HTML snapshots with the depth and page cap of a deeper crawl."""
    pages = snapshots.where(F.lower("content_type").contains("text/html"))
    return pages.withColumns({"depth": F.least(F.lit(5), depth + 1), "max_pages": F.least(F.lit(40), most)})


def operations_check(free: Column, total: Column, least_percent: float, streaks: Column) -> Column:
    """Alerts of one check: disk, streaks, or none."""
    low = free * 100.0 < total * least_percent
    return F.filter(F.array(F.when(low, F.lit("disk")), F.when(streaks > 0, F.lit("failures"))), lambda x: x.isNotNull())
