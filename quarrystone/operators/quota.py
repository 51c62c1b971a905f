"""Storage quotas: use, reservations, reports, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a limit from which a warning is due, in per cent.
WARNING_PERCENT = 80


def owner_usage(users: DataFrame, sites: DataFrame, snapshots: DataFrame, assets: DataFrame) -> DataFrame:
    """owner_id, used: bytes of an owner's snapshots and of their assets, each summed before any join."""
    owner = sites.select(F.col("id").alias("site_id"), "owner_id")
    of_snapshot = snapshots.select(F.col("id").alias("snapshot_id"), "site_id", "bytes")
    per_asset = assets.groupBy("snapshot_id").agg(F.sum("bytes").alias("asset_bytes"))
    total = of_snapshot.join(per_asset, "snapshot_id", "left").select("site_id", (F.col("bytes") + F.coalesce("asset_bytes", F.lit(0))).alias("b"))
    by_site = total.groupBy("site_id").agg(F.sum("b").alias("b"))
    used = by_site.join(owner, "site_id").groupBy("owner_id").agg(F.sum("b").alias("used"))
    ids = users.select(F.col("id").alias("owner_id"))
    return ids.join(used, "owner_id", "left").select("owner_id", F.coalesce("used", F.lit(0)).alias("used"))


def reservations(sites: DataFrame, jobs: DataFrame) -> DataFrame:
    """owner_id, reserved: what running jobs and those that wait to resume have reserved."""
    active = jobs.where("status = 'running' or (status = 'interrupted' and auto_resume)").groupBy("site_id").agg(F.sum("reserved").alias("r"))
    return active.join(sites.select(F.col("id").alias("site_id"), "owner_id"), "site_id").groupBy("owner_id").agg(F.sum("r").alias("reserved"))


def quota_columns(limit: Column, used: Column, reserved: Column) -> dict[str, Column]:
    """Committed, available, per cent used and committed, warning and over; no limit: nulls and false."""
    committed = used + reserved
    percent = lambda x: F.when(limit.isNull(), None).when(limit == 0, F.when(x > 0, 100.0).otherwise(0.0)).otherwise(x * 100.0 / limit)
    return {
        "committed": committed,
        "available": F.when(limit.isNotNull(), F.greatest(F.lit(0), limit - committed)),
        "percent_used": percent(used),
        "percent_committed": percent(committed),
        "warning": F.coalesce(percent(committed) >= WARNING_PERCENT, F.lit(False)),
        "over": F.coalesce(used > limit, F.lit(False)),
    }


def quota_report(users: DataFrame, used: DataFrame, reserved: DataFrame) -> DataFrame:
    rows = users.select(F.col("id").alias("owner_id"), "name", "email", "quota").join(used, "owner_id", "left").join(reserved, "owner_id", "left")
    filled = rows.withColumns({"used": F.coalesce("used", F.lit(0)), "reserved": F.coalesce("reserved", F.lit(0))})
    return filled.withColumns(quota_columns(F.col("quota"), F.col("used"), F.col("reserved")))


def admission(requests: DataFrame, jobs: DataFrame, report: DataFrame, most_running: int) -> DataFrame:
    """``decision`` of each request (site_id, owner_id, required): the first rule that refuses it, or ``admit``."""
    active = jobs.where("status = 'running'").groupBy("site_id").agg(F.min("id").alias("active_job"))
    running = jobs.where("status = 'running'").agg(F.count("*").alias("running"))
    rows = requests.join(active, "site_id", "left").join(report.select("owner_id", "available"), "owner_id", "left").crossJoin(running)  # one row
    decision = F.when(F.col("active_job").isNotNull(), "site_active").when(F.col("running") >= most_running, "capacity").when(F.col("required") > F.col("available"), "quota").otherwise("admit")
    return rows.withColumn("decision", decision)
