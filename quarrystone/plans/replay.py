"""Queries on the replay of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions.text import escape_html
from ..operators import compare, replay
from ..sources.tables import Archive
from .registry import query

ORIGIN = "https://replay.test"
_RULES = ('<meta http-equiv="Content-Security-Policy" content="' + "; ".join(f"{k} {v}" for k, v in html.REPLAY_RULES.items()) + ';">').replace("'", "''")
_OFF = f"""'<script>', '<script type="{html.DISABLED_SCRIPT}">'"""
_OUT = ' target="_blank" rel="noopener noreferrer external">'


def _unmapped(a: Archive) -> DataFrame:
    return a.spark.createDataFrame([], "run_id string, key string, snapshot_id long")


@query(f"""select page_id, regexp_replace(replace(html, {_OFF}), '<a href="(/[^"]*)">', '<a href="' || split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '\\1"{_OUT}', 'g') as replay from pages""")
def htm15_replay(a: Archive):
    pages = a.raw("pages").select(F.col("page_id").alias("id"), F.lit("").alias("run_id"), "url", F.col("html").alias("body"))
    return replay.navigation(pages, _unmapped(a), "").select(F.col("id").alias("page_id"), F.col("body").alias("replay"))


#: The pages of a run link to each other here: the first four links of a page lead to itself and the next pages of its run, written in
#: four ways with a fragment, the sixth is a script; pages at a run's end keep their own links. Every page has a form.
_BARE = "split_part(url, '#', 1)"
_KEY = f"regexp_replace({_BARE}, '^([a-z]+://[^/?]*)(\\?|$)', '\\1/\\2')"


def _written(i: Column, near: Column) -> Column:
    """The reference to a page of the run, by its place."""
    bare = F.split_part(near, F.lit("#"), F.lit(1))
    rest = F.substring(bare, F.locate("://", bare) + 3, F.length(bare))
    loud = F.concat(F.upper(F.split_part(bare, F.lit("://"), F.lit(1))), F.lit("://"), F.upper(F.split_part(rest, F.lit("/"), F.lit(1))), F.substring(rest, F.locate("/", rest), F.length(rest)))
    return (
        F.when(i == 0, F.concat(F.lit('<a href="'), bare, F.lit('#s0">')))
        .when(i == 1, F.concat(F.lit('<A id=x HREF = "'), loud, F.lit('#s1">')))
        .when(i == 2, F.concat(F.lit('<a href="//'), rest, F.lit('#s2">')))
        .when(i == 3, F.concat(F.lit("<a href='"), escape_html(bare), F.lit("#s&lt;3' target='x'>")))
    )


def _linked_runs(a: Archive) -> DataFrame:
    pages = a.snapshots.select("id", "run_id", F.col("source_url").alias("url"), "body")
    order = Window.partitionBy("run_id").orderBy("id")
    near = pages.select("id", F.array(*(F.lead("url", k).over(order) for k in range(4))).alias("near"))
    rows = pages.join(near, "id").withColumn("tags", html.anchors(F.col("body")))
    script = F.lit('<a class=c href="JavaScript:go()">')
    tags = F.transform("tags", lambda t, i: F.coalesce(_written(i, F.try_element_at("near", i + 1)), F.when(i == 5, script), t))
    form = F.replace(html.with_anchors(F.col("body"), tags), F.lit("<article>"), F.lit('<article><form method=post action="/go"><input></form><FORM inert></FORM>'))
    return rows.select("id", "run_id", "url", form.alias("body"))


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '\"', '&quot;'), '''', '&#x27;')"
_TAG = f"""case when k < 4 and near is not null and stored is not null then case k when 1 then '<A id=x HREF = "' when 3 then '<a href=''' else '<a href="' end || '{ORIGIN}/snapshots/' || stored || '/content#s' ||
      case k when 3 then '&lt;3'' target=''x''>' else k || '">' end
    when k = 2 and near is not null then '<a href="' || {_ESCAPED.format("split_part(url, ':', 1) || '://' || split_part(split_part(near, '#', 1), '://', 2)")} || '#s2"{_OUT}'
    when k = 5 then '<a class=c href="#">' else '<a href="' || split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || own || '"{_OUT}' end"""
_REPLAYED = f"""pg as (select page_id as id, page_id // 25 as run, url, html, {_KEY} as key from pages),
    map as (select run, key, max(id) as stored from pg group by all),
    near as (select id, run, url, html, [url, lead(url, 1) over w, lead(url, 2) over w, lead(url, 3) over w] as near from pg window w as (partition by run order by id)),
    tags as (select id, run, url, (generate_subscripts(l, 1) - 1)::int as k, unnest(l) as own, near from (select *, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from near)),
    found as (select t.id, k, own, t.url, near[k + 1] as near, stored from tags t left join map m on k < 4 and m.run = t.run
      and m.key = if(k = 2, split_part(t.url, ':', 1) || '://' || split_part({_KEY.replace("url", "near[k + 1]")}, '://', 2), {_KEY.replace("url", "near[k + 1]")})),
    led as (select id, list({_TAG} order by k) as tags from found group by id),
    whole as (select id, url, array_to_string(list_transform(generate_series(1, len(p)), lambda i: p[i] || coalesce(tags[i], '')), '') as body
      from (select id, url, string_split_regex(html, '<a href="[^"]*">') as p from pg) join led using (id)),
    off as (select id, url, replace(replace(body, {_OFF}), '<article>', '<article><form method=post action="about:blank" inert><input></form><FORM inert action="about:blank"></FORM>') as body from whole)"""


@query(f"with {_REPLAYED} select id, body as replay from off")
def htm15_replay_of_runs(a: Archive):
    return replay.navigation(_linked_runs(a), compare.page_map(a.snapshots), ORIGIN).select("id", F.col("body").alias("replay"))


@query(f"""with {_REPLAYED} select id, replace(body, '<head>', '<head><base href="{ORIGIN}/">{_RULES}<style>.menu{{display:block}}</style>') as page from off""")
def htm16_replay_of_runs(a: Archive):
    trackers = F.lit('<IFRAME src="https://www.googletagmanager.com/ns.html?id=1"></iframe><meta name=x http-equiv="Content-Security-Policy" content="x">')
    pages = _linked_runs(a).withColumn("body", F.concat("body", trackers))
    return replay.documents(pages, compare.page_map(a.snapshots), ORIGIN, "<style>.menu{display:block}</style>").select("id", F.col("body").alias("page"))


@query(f"""select page_id, replace(html, '<head>', '<head>{_RULES}') || '<base href="' || {_ESCAPED.format("url")} || '"><base target=y>' as page from pages""")
def htm16_replay_documents(a: Archive):
    added = F.lit('<iframe src="https://www.googletagmanager.com/ns.html?id=1"></iframe><BASE href="/old/"><base target=y><meta http-equiv="Content-Security-Policy" content="x">')
    return a.raw("pages").select("page_id", html.replay_document(F.concat(F.col("html"), added), F.col("url")).alias("page"))
