"""Archive search: sites, page metadata, then page text, under row-level visibility."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, html, text

#: Newest snapshots that are looked at, and results.
POOL, RESULTS = 500, 100


def visible(owner: Column, visibility: Column, user: int | None) -> Column:
    """The owner's own rows and public ones; guests see public ones."""
    public = visibility == "public"
    return public if user is None else public | (owner == user)


def search(sites: DataFrame, snapshots: DataFrame, user: int | None, term: str, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
    """kind (site, page, content), id, site_id, label, excerpt, rank; at most RESULTS rows.

    The pool of the newest snapshots is cut before visibility and dates. The text of a page
    is read only where its metadata don't match; dates bound no sites.
    """
    q = term.strip().lower()[:200]
    seen = sites.where(visible(F.col("owner_id"), F.col("visibility"), user)).select(F.col("id").alias("site_id"), F.col("name").alias("site_name"), F.col("url").alias("site_url"))
    none = F.lit(None).cast("string")
    hits = seen.where(text.contains_any(q, F.col("site_name"), F.col("site_url")) if q else F.lit(False)).select(F.lit("site").alias("kind"), F.col("site_id").alias("id"), "site_id", F.col("site_name").alias("label"), none.alias("excerpt"), F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(0).alias("k"))
    pool = snapshots.orderBy(F.desc("created_at"), "id").limit(POOL)
    mine = pool.join(seen, "site_id").where(dates.in_days(F.col("created_at"), F.lit(first).cast("date"), F.lit(last).cast("date")))
    meta = text.contains_any(q, F.col("source_url"), F.col("final_url"))
    found = mine.withColumn("meta", meta if q else F.lit(first is not None or last is not None))
    body = F.when(~F.col("meta") & F.lit(bool(q)), text.excerpt(html.search_text(F.col("body"), F.col("content_type")), q or " "))
    pages = found.withColumn("excerpt", body).where("meta or excerpt is not null").select(F.when(F.col("meta"), "page").otherwise("content").alias("kind"), "id", "site_id", F.col("source_url").alias("label"), "excerpt", F.col("created_at").alias("t"), F.lit(1).alias("k"))
    order = [F.col("k"), F.col("t").desc_nulls_last(), F.col("id")]
    top = hits.unionByName(pages).orderBy(*order).limit(RESULTS)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("t", "k")  # at most RESULTS rows
