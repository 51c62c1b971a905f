"""Replay of stored pages: links between pages of a run lead to their copies, everything that would act or call out is off.

Links are cut out with their places, looked up in the page map of their run by a join, and put back into the pages, so a map
may be of any size and no page carries one. Only links are shuffled for the look-up; bodies once, to meet their links again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, html_kernels, urls
from .joins import lookup


def link_targets(pages: DataFrame) -> DataFrame:
    """id, run_id, pos, tag, raw, target: the anchors of each page in order; ``raw`` is the decoded reference, null where there is none to follow."""
    tags = pages.select("id", "run_id", "url", F.posexplode(html.anchors(F.col("body"))).alias("pos", "tag"))
    decoded = tags.withColumn("raw", html_kernels.unescape(F.btrim(html.anchor_href(F.col("tag")))))
    leads = (F.col("raw") != "") & ~F.col("raw").rlike("^(?:#|mailto:|tel:)")
    kept = decoded.withColumn("raw", F.when(leads, F.col("raw")))
    return kept.withColumn("target", F.when(~F.lower("raw").rlike("^(?:javascript|data):"), urls.resolve(F.col("url"), F.col("raw"))))


def linked(pages: DataFrame, page_map: DataFrame, origin: str) -> DataFrame:
    """``pages`` (id, run_id, url, body and more; ids are unique), their anchors led to stored copies or out of the archive.

    ``page_map`` holds run_id, key, snapshot_id. A link to a page of the same run goes to ``origin``'s copy of it and keeps its fragment; any
    other one to its absolute address in a new tab; scripts and data nowhere. Without ``origin`` no link goes to a copy.
    """
    links = link_targets(pages).withColumn("key", urls.replay_link_key(F.col("target")))
    if origin:
        links = lookup(links, page_map.select("run_id", "key", "snapshot_id"), ["run_id", "key"])
        mark = F.when(urls.fragment(F.col("target")) == "", F.lit("")).otherwise(F.concat(F.lit("#"), urls.fragment(F.col("target"))))
        copy = F.concat(F.lit(f"{origin.rstrip('/')}/snapshots/"), F.col("snapshot_id").cast("string"), F.lit("/content"), mark)
    else:
        copy = F.lit(None).cast("string")
    tag = html.led_anchor(F.col("tag"), F.col("raw"), F.col("target"), copy)
    by_page = links.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", tag.alias("tag")))).alias("_tags"))
    met = pages.join(by_page.select("id", F.transform("_tags", lambda t: t["tag"]).alias("_tags")), "id", "left")
    return met.withColumn("body", html.with_anchors(F.col("body"), F.col("_tags"))).select(*pages.columns)


def navigation(pages: DataFrame, page_map: DataFrame, origin: str) -> DataFrame:
    """``linked``, with forms and scripts disabled."""
    return linked(pages, page_map, origin).withColumn("body", html.disabled_scripts(html.disabled_forms(F.col("body"))))


def documents(pages: DataFrame, page_map: DataFrame, origin: str, repairs: str = "") -> DataFrame:
    """Whole replay documents: no tracker frames, stored assets absolute, navigation within the archive, one base and the content rules of a replay."""
    bare = pages.withColumn("body", html.absolute_assets(html.without_trackers(F.col("body")), origin) if origin else html.without_trackers(F.col("body")))
    base = F.lit(origin.rstrip("/") + "/") if origin else F.col("url")
    return navigation(bare, page_map, origin).withColumn("body", html.replay_rules(F.col("body"), base, repairs))
