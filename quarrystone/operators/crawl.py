"""Bounded breadth-first crawls of a link graph, one for each job, and where they begin.

A driver loop over levels, at most ``max_depth`` of them; each level is a join of the frontiers
with the edges, an anti-join with what is known, and a cut at the cap. Levels are written by
``checkpoint()`` to the shared folder, so plans stay short and lost executors cost little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import checkpointed
from .joins import dealt


def seeds(jobs: DataFrame, failed: DataFrame, max_pages: int, mode: str, include: list[str], exclude: list[str]) -> DataFrame:
    """job_id, url, problem: where each job (job_id, retried, start_url, site_url) begins.

    A retry begins at the first ``max_pages`` distinct addresses (retried, url, pos) that failed before, any other job at
    its start address, else its site's. Addresses are made canonical and must be pages of the site's host that
    the policy admits; a job that none is left for gets one row with a problem.
    """
    address = lambda *urls_: urls.canonical_url(F.coalesce(*urls_), mode)
    ok = (urls.host_key(F.col("url")) == urls.host_key(F.col("site_url"))) & urls.looks_like_page(F.col("url")) & urls.matches_policy(F.col("url"), include, exclude)
    told = lambda rows: rows.select("job_id", "url", F.when(F.col("url").isNull(), "no starting address is permitted").alias("problem"))
    # jobs that retry nothing share one null key, so they stay where they are
    plain = jobs.where("retried is null").withColumn("url", address("start_url", "site_url")).withColumn("url", F.when(ok, F.col("url")))
    retries = jobs.where("retried is not null")
    once = dealt(failed, "retried").join(retries.select("retried"), "retried", "left_semi").groupBy("retried", "url").agg(F.min("pos").alias("pos"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("retried").orderBy("pos"))).where(F.col("n") <= max_pages)
    known = retries.join(first.select("retried", F.col("url").alias("again")), "retried", "left").withColumn("url", address("again", "start_url", "site_url"))
    kept = known.groupBy("job_id").agg(F.collect_set(F.when(ok, F.col("url"))).alias("urls"))
    return told(plain).unionByName(told(kept.select("job_id", F.explode_outer("urls").alias("url"))))


def crawl(edges: DataFrame, starts: DataFrame, max_depth: int, max_pages: int, failed: DataFrame | None = None) -> DataFrame:
    """job, rank, url, depth of every job's frontier in the order of its queue.

    ``edges`` holds src, pos, dst; ``starts`` job, pos, url. The first discovery fixes an address's
    depth; failed pages lead nowhere; the cap counts a job's frontier rows. Jobs are ranked apart, and the windows'
    cuts at the cap run in every task before rows meet, so neither one job nor all of them are ever sorted in one place.
    """
    edges = checkpointed(edges.select("src", "pos", "dst"))  # every level joins them
    order = lambda c: Window.partitionBy("job").orderBy(c)
    firsts = starts.groupBy("job", "url").agg(F.min("pos").alias("pos")).withColumn("rank", F.row_number().over(order("pos"))).where(F.col("rank") <= max_pages)
    known = checkpointed(firsts.select("job", "rank", "url", F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        level = known.where(F.col("depth") == depth - 1)
        if failed is not None:
            level = level.join(failed.select("url"), "url", "left_anti")
        found = level.join(edges, level["url"] == edges["src"]).groupBy("job", F.col("dst").alias("url")).agg(F.min(F.struct("rank", "pos")).alias("o"))
        room = known.groupBy("job").agg(F.count("*").cast("int").alias("n"))
        new = found.join(known.select("job", "url"), ["job", "url"], "left_anti").withColumn("k", F.row_number().over(order("o"))).where(F.col("k") <= max_pages)
        ranked = new.join(room, "job").withColumn("rank", F.col("k") + F.col("n")).where(F.col("rank") <= max_pages)
        more = checkpointed(ranked.select("job", "rank", "url", F.lit(depth).alias("depth")))
        if more.isEmpty():
            break
        known = known.unionByName(more)
    return known
