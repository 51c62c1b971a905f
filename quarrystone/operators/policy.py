"""Crawl policies and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import interval_days, next_after


def size_ceiling(pages: Column, page_bytes: Column, asset_bytes: Column, assets: Column) -> Column:
    """The most bytes that a crawl can store."""
    at_least = lambda c, n: F.greatest(c, F.lit(n))
    return at_least(pages, 1) * (at_least(page_bytes, 0) + at_least(asset_bytes, 0) * at_least(assets, 0))


def normalized(delay: Column, timeout: Column, robots: Column, query_mode: Column) -> dict[str, Column]:
    """Policies in their bounds; unknown choices become the defaults."""
    bounded = lambda c, low, high, default: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(default))))
    one_of = lambda c, options, default: F.when(F.lower(c).isin(*options), F.lower(c)).otherwise(default)
    return {
        "delay": bounded(delay, 1.0, 120.0, 5.0), "timeout": bounded(timeout, 5.0, 120.0, 25.0),
        "robots": one_of(robots, ("respect", "owner_override"), "respect"), "query_mode": one_of(query_mode, ("preserve", "normalize", "drop"), "normalize"),
    }


def migrated(sites: DataFrame) -> DataFrame:
    """Sites (delay, pages, interval, last, next_at) with safer defaults: delays of 2 s or less become 5, a cap of 80 pages
    25, and the next capture follows the last one; without a last one it stays."""
    days = interval_days(F.col("interval"), F.lit(None).cast("string"))
    return sites.withColumns({
        "delay": F.when(F.coalesce("delay", F.lit(0.0)) <= 2, 5.0).otherwise(F.col("delay")), "pages": F.when(F.col("pages") == 80, 25).otherwise(F.col("pages")),
        "next_at": F.coalesce(next_after(F.col("last"), days), F.col("next_at")),
    })


def backoff(t: Column, due: Column, hours: int = 6) -> Column:
    return F.when(due, t + F.make_dt_interval(hours=F.lit(hours))).otherwise(t)


def due_sites(sites: DataFrame, now: Column, slots: int) -> DataFrame:
    """Sites that aren't paused and whose time has come, never captured ones first, as many as there are slots."""
    due = sites.where(~F.col("paused") & (F.col("next_at").isNull() | (F.col("next_at") <= now)))
    return due.orderBy(F.col("next_at").asc_nulls_first(), "id").limit(max(0, slots))


def schedule(sites: DataFrame, now: Column, slots: int, digests: DataFrame | None = None) -> DataFrame:
    """``due_sites`` without those whose home page still has the digest of their last capture."""
    picked = due_sites(sites, now, slots)
    if digests is None:
        return picked
    joined = picked.join(digests.select(F.col("site_id").alias("id"), "last_digest", "current_digest"), "id", "left")
    return joined.where(F.col("last_digest").isNull() | ~F.col("last_digest").eqNullSafe(F.col("current_digest"))).drop("last_digest", "current_digest")
