"""Ordered localisation: which resources of a page are stored, in which order, under a budget for each page.

First what the page itself names: links, sources, source sets, inline styles. What is left of the budget goes to stylesheets, the one
with the fewest ``url()`` first, and what they import and load, until no stylesheet is left or the budget is used up. Each address is stored once a page,
by the address that names it or the one it leads to.

The order within a page depends on all that came before, so it is a fold over the page's own short list. Stylesheets are shared by many
pages: their references are worked out once, as a graph, and a round of the loop fetches those of all stylesheets that pages have met by one
join, then each page goes on as far as it knows. So rounds are as many as stylesheets are nested, not as many as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, html_kernels, urls
from ..sources.shared import checkpointed
from .joins import lookup

#: Fixed value: resources stored for a page at most.
MOST = 120
#: Stylesheets of a round that are sent to all tasks; more are joined by a shuffle.
FEW = 100_000
_ASSET = "struct<url:string,final_url:string,stage:string,depth:int,css:boolean,urls:int>"
_KNOWN = "array<struct<url:string,deps:array<struct<url:string,final_url:string,css:boolean,urls:int>>>>"
_STATE = f"struct<assets:array<{_ASSET}>,done:array<string>,pick:struct<urls:int,at:int,url:string,depth:int>,over:boolean>"


def _addressed(refs: DataFrame) -> DataFrame:
    """Rows of ``refs`` (base, raw) with ``url``, the address to store, without fragment; without those that are stored already or can't be fetched."""
    fetched = lambda x: F.when(x.rlike("(?i)^https?://[^/?#]") & ~x.rlike("^[^/]*//[^/?#]*/snapshots/"), x)
    found = lambda raw: urls.bound(F.regexp_replace(urls.replay_reference(F.col("base"), raw), "#.*$", ""), fetched)
    return refs.withColumn("raw", html_kernels.unescape("raw")).withColumn("url", found(F.col("raw"))).drop("base", "raw").where("url is not null")


def page_references(pages: DataFrame) -> DataFrame:
    """id, pos, stage, url: what pages (id, url, body) name themselves, in order of priority."""
    rows = pages.select("id", "url", html_kernels.lazy_sources(F.col("body")).alias("body"))
    told = rows.withColumn("told", html_kernels.unescape(html.base_href(F.col("body")))).withColumn("base", urls.resolve(F.col("url"), F.col("told")))
    refs = told.select("id", F.coalesce("base", "url").alias("base"), F.posexplode(html.resources(F.col("body"))).alias("pos", "r"))
    named = refs.select("id", "base", "pos", "r.stage", F.col("r.url").alias("raw")).where("not lower(raw) like 'javascript:%'")
    return _addressed(named).select("id", "pos", "stage", "url")


def stylesheet_graph(resources: DataFrame) -> DataFrame:
    """url, deps: what each stylesheet of ``resources`` (url, final_url, content_type, body) loads of them, in order."""
    styles = resources.where(F.lower("content_type").contains("text/css"))
    refs = styles.select(F.col("url").alias("style"), F.coalesce("final_url", "url").alias("base"), F.posexplode(html.css_references(F.col("body"))).alias("pos", "raw"))
    met = lookup(_addressed(refs).select("style", "pos", "url"), had(resources), ["url"], 2).where("css is not null")
    by_style = met.groupBy("style").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "final_url", "css", "urls"))).alias("deps"))
    return by_style.select(F.col("style").alias("url"), F.transform("deps", lambda d: F.struct(d["url"], d["final_url"], d["css"], d["urls"])).alias("deps"))


def had(resources: DataFrame) -> DataFrame:
    """url, final_url, css, urls of each resource."""
    return resources.select("url", F.coalesce("final_url", "url").alias("final_url"), F.lower("content_type").contains("text/css").alias("css"), html.css_url_count(F.coalesce("body", F.lit(""))).cast("int").alias("urls"))


def _added(assets: Column, found: Column, stage: Column, depth: Column, most: int) -> Column:
    """``assets`` with those found that are new, in order, up to ``most``."""

    def one(kept: Column, r: Column) -> Column:
        known = F.exists(kept, lambda a: (a["url"] == r["url"]) | (a["final_url"] == r["url"]))
        new = F.struct(r["url"].alias("url"), r["final_url"].alias("final_url"), stage(r).alias("stage"), depth.cast("int").alias("depth"), r["css"].alias("css"), r["urls"].alias("urls"))
        return F.when(known | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(new)))

    return F.aggregate(found, assets, one)


def _gone_on(assets: Column, done: Column, known: Column, most: int) -> Column:
    """The state of a page that goes on with all stylesheets it knows: one step picks the next, one takes it in, until one isn't known or none is left."""

    def step(s: Column, _: Column) -> Column:
        left = F.filter(s["assets"], lambda a: a["css"] & ~F.array_contains(s["done"], a["url"]))
        pick = F.array_min(F.transform(left, lambda a, i: F.struct(a["urls"].alias("urls"), i.alias("at"), a["url"].alias("url"), a["depth"].alias("depth"))))
        picked = F.struct(s["assets"].alias("assets"), s["done"].alias("done"), F.when(F.size(s["assets"]) < most, pick).alias("pick"), (F.size(left) == 0).alias("over"))
        deps = F.get(F.filter(known, lambda k: k["url"] == s["pick"]["url"]), F.lit(0))["deps"]
        more = _added(s["assets"], deps, lambda r: F.lit("css_dependency"), s["pick"]["depth"] + 1, most)
        taken = F.struct(more.alias("assets"), F.array_append(s["done"], s["pick"]["url"]).alias("done"), F.lit(None).alias("pick"), F.lit(False).alias("over"))
        known_now = F.exists(known, lambda k: k["url"] == s["pick"]["url"])
        return F.when(s["over"], s).when(s["pick"].isNull(), picked.cast(_STATE)).when(known_now, taken.cast(_STATE)).otherwise(s)

    start = F.struct(assets.alias("assets"), done.alias("done"), F.lit(None).alias("pick"), F.lit(False).alias("over")).cast(_STATE)
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * most + 1)), start, step)


def localised(pages: DataFrame, resources: DataFrame, most: int = MOST) -> DataFrame:
    """id, rank, url, final_url, stage, depth: the resources stored for each page (id, url, body), ranked from 1 in the order they are stored.

    ``resources`` (url, final_url, content_type, body) is what can be had, each url once; what isn't there takes no place. ``depth`` is 0
    for what the page names, else one more than its stylesheet's. Pages that name nothing give no row.
    """
    refs = lookup(page_references(pages), had(resources), ["url"], 1).where("css is not null")
    by_page = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "final_url", "css", "urls", "stage"))).alias("found"))
    first = _added(F.array().cast(f"array<{_ASSET}>"), F.col("found"), lambda r: r["stage"], F.lit(0), most)
    graph = checkpointed(stylesheet_graph(resources))
    known, none = F.array().cast(_KNOWN), F.array().cast("array<string>")
    state = checkpointed(by_page.select("id", _gone_on(first, none, known, most).alias("s"), known.alias("known")))
    finished = []
    while True:
        finished.append(state.where("s.pick is null").select("id", "s.assets"))
        active = state.where("s.pick is not null")
        if active.isEmpty():
            break
        met = F.filter("s.assets", lambda a: a["css"] & ~F.exists("known", lambda k: k["url"] == a["url"]))
        needed = active.select("id", F.explode(F.transform(met, lambda a: a["url"])).alias("url"))
        needed = checkpointed(needed)
        asked = needed.select("url").distinct()
        asked = F.broadcast(asked) if asked.count() <= FEW else asked  # then the graph stays where it is
        got = lookup(needed, graph.join(asked, "url", "left_semi"), ["url"], 1).groupBy("id").agg(F.collect_list(F.struct("url", F.coalesce("deps", F.array().cast("array<struct<url:string,final_url:string,css:boolean,urls:int>>")).alias("deps"))).alias("got"))
        more = active.join(got, "id").select("id", "s", F.concat("known", F.col("got").cast(_KNOWN)).alias("known"))
        state = checkpointed(more.select("id", _gone_on(F.col("s.assets"), F.col("s.done"), F.col("known"), most).alias("s"), "known"))
    every = finished[0]
    for f in finished[1:]:
        every = every.unionByName(f)
    ranked = every.select("id", F.posexplode("assets").alias("at", "a"))
    return ranked.select("id", (F.col("at") + 1).alias("rank"), "a.url", "a.final_url", "a.stage", "a.depth")
