"""Queries on archive search, comparison, dashboards and the crawl."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import compare, crawl, objects, search
from ..sources.tables import Archive
from .registry import query


@query("select id, name from sites where owner_id = 3 or visibility = 'public'", ("sites",))
def flt1_visible_sites(a: Archive):
    return a.sites.where(search.visible(F.col("owner_id"), F.col("visibility"), 3)).select("id", "name")


@query("select id, name from sites where visibility = 'public'", ("sites",))
def dsh3_public_archive(a: Archive):
    return a.sites.where(search.visible(F.col("owner_id"), F.col("visibility"), None)).select("id", "name")


_VISIBLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g'))"""


@query(
    f"""select kind, id, site_id, label, excerpt, row_number() over (order by k, t desc nulls last, id) as rank from (
    select 'site' as kind, id, id as site_id, name as label, null as excerpt, null::timestamp as t, 0 as k from sites where (owner_id = 3 or visibility = 'public') and (contains(lower(name), 'blog') or contains(lower(url), 'blog'))
    union all select if(meta, 'page', 'content'), id, site_id, source_url, if(meta, null, excerpt), created_at, 1 from (
      select p.*, contains(lower(source_url), 'blog') as meta, if(p0 > 0, if(greatest(p0 - 90, 1) > 1, '…', '') || trim(substr(v, greatest(p0 - 90, 1), least(p0 + 94, length(v) + 1) - greatest(p0 - 90, 1))) || if(least(p0 + 94, length(v) + 1) <= length(v), '…', ''), null) as excerpt
      from (select *, instr(lower(v), 'blog') as p0 from (select *, if(regexp_matches(lower(content_type), 'text|json|xml'), {_VISIBLE}, '') as v from (select * from snapshots order by created_at desc, id limit 500))) p
      join sites s on s.id = p.site_id where (s.owner_id = 3 or s.visibility = 'public') and p.created_at >= timestamp '2024-01-03' and p.created_at < timestamp '2024-05-01') where meta or excerpt is not null)
    order by k, t desc nulls last, id limit 100""",
    ("sites", "snapshots"),
)
def sea1_archive_search(a: Archive):
    import datetime

    return search.search(a.sites, a.snapshots, 3, " Blog ", datetime.date(2024, 1, 3), datetime.date(2024, 4, 30))


@query(
    f"""select kind, id, site_id, label, excerpt, row_number() over (order by t desc, id) as rank from (select 'content' as kind, p.id, p.site_id, p.source_url as label, p.created_at as t,
      if(greatest(p0 - 90, 1) > 1, '…', '') || trim(substr(v, greatest(p0 - 90, 1), least(p0 + 98, length(v) + 1) - greatest(p0 - 90, 1))) || if(least(p0 + 98, length(v) + 1) <= length(v), '…', '') as excerpt
      from (select *, instr(lower(v), 'therhean') as p0 from (select *, if(regexp_matches(lower(content_type), 'text|json|xml'), {_VISIBLE}, '') as v from (select * from snapshots order by created_at desc, id limit 500))) p
      join sites s on s.id = p.site_id where s.visibility = 'public' and p0 > 0) order by t desc, id limit 100""",
    ("sites", "snapshots"),
)
def sea1_guest_content_search(a: Archive):
    return search.search(a.sites, a.snapshots, None, "therhean")


_KEY = r"lower(regexp_extract(source_url, '^([^:/?#]+):', 1)) || '://' || lower(regexp_extract(source_url, '^[^:/?#]+://([^/?#]*)', 1)) || if(regexp_extract(source_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '', '/', regexp_extract(source_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) || coalesce(nullif(regexp_extract(source_url, '(\?[^#]+)', 1), ''), '')"
_SIDES = """with l as (select doc_id % 997 as key, arg_max(sha256(text), doc_id) as d from documents where doc_id % 2 = 0 or doc_id % 5 = 0 group by key),
    r as (select doc_id % 997 as key, arg_max(sha256(text), doc_id) as d from documents where doc_id % 2 = 1 or doc_id % 3 = 0 group by key)"""


def _sides(a: Archive):
    side = lambda rows: compare.keyed(rows, (F.col("id") % 997), F.col("digest"))
    return compare.changes(side(a.assets.where("id % 2 = 0 or id % 5 = 0")), side(a.assets.where("id % 2 = 1 or id % 3 = 0")))


@query(_SIDES + " select coalesce(l.key, r.key) as key, case when l.key is null then 'added' when r.key is null then 'removed' when l.d = r.d then 'unchanged' else 'changed' end as change from l full join r on l.key = r.key")
def cmp1_resource_changes(a: Archive):
    return _sides(a)


@query(
    _SIDES
    + """, c as (select coalesce(l.key, r.key) as key, case when l.key is null then 'added' when r.key is null then 'removed' when l.d = r.d then 'unchanged' else 'changed' end as change from l full join r on l.key = r.key)
    select key, change, row_number() over (partition by change order by key) as rank, count(*) over (partition by change) as n from c qualify rank <= 100"""
)
def srt11_listed_changes(a: Archive):
    return compare.listed(_sides(a)).select("key", "change", "rank", "n")


@query(
    f"""select coalesce(l.key, r.key) as key, case when l.key is null then 'added' when r.key is null then 'removed' when l.d = r.d then 'unchanged' else 'changed' end as change
    from (select {_KEY} as key, arg_max(digest, id) as d from snapshots where run_id = 'run_1' group by key) l full join (select {_KEY} as key, arg_max(digest, id) as d from snapshots where run_id = 'run_2' group by key) r on l.key = r.key""",
    ("snapshots",),
)
def cmp1_page_changes(a: Archive):
    return compare.compare_runs(a.snapshots, "run_1", "run_2")


@query(f"select run_id, {_KEY} as key, max(id) as snapshot_id from snapshots group by all", ("snapshots",))
def jn17_page_map(a: Archive):
    return compare.page_map(a.snapshots)


@query(
    """select s.site_id, count(distinct coalesce(s.run_id, s.id::varchar)) as captures, arg_max(s.id, (s.created_at, -s.id)) as latest_id, max(s.created_at) as latest_at, count(*) as pages, sum(bytes)::bigint as bytes from snapshots s group by s.site_id""",
    ("snapshots",),
)
def dsh1_site_rows(a: Archive):
    return a.snapshots.groupBy("site_id").agg(
        F.countDistinct(F.coalesce("run_id", F.col("id").cast("string"))).alias("captures"), F.max_by("id", F.struct("created_at", -F.col("id"))).alias("latest_id"),
        F.max("created_at").alias("latest_at"), F.count("*").alias("pages"), F.sum("bytes").alias("bytes"),
    )


@query("select run_id, min(id) as entry_id, count(*) as pages, min(created_at) as started_at from snapshots group by run_id order by started_at desc, run_id desc limit 200", ("snapshots",))
def dsh2_runs_of_archive(a: Archive):
    runs = a.snapshots.groupBy("run_id").agg(F.min("id").alias("entry_id"), F.count("*").alias("pages"), F.min("created_at").alias("started_at"))
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(200)


@query("select id from snapshots where contains(lower(content_type), 'text/html') and kind <> 'wayback'", ("snapshots",))
def flt8_html_snapshots(a: Archive):
    return a.snapshots.where(F.lower("content_type").contains("text/html") & (F.col("kind") != "wayback")).select("id")


@query("select id, created_at from snapshots where created_at >= timestamp '2024-01-02' and created_at < timestamp '2024-01-06'", ("snapshots",))
def flt7_date_range(a: Archive):
    from ..functions.dates import in_days

    return a.snapshots.where(in_days(F.col("created_at"), F.lit("2024-01-02").cast("date"), F.lit("2024-01-05").cast("date"))).select("id", "created_at")


@query("select id, created_at from snapshots order by created_at desc, id limit 500", ("snapshots",))
def win6_candidate_pool(a: Archive):
    return a.snapshots.select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(search.POOL)


@query("select digest from snapshots intersect select digest from snapshots where run_id <> 'run_1'", ("snapshots",))
def set1_shared_digests(a: Archive):
    return a.snapshots.select("digest").intersect(a.snapshots.where("run_id <> 'run_1'").select("digest"))


@query("select digest from snapshots union select digest from assets", ("snapshots", "assets"))
def set2_referenced_digests(a: Archive):
    return a.snapshots.select("digest").unionByName(a.assets.select("digest")).distinct()


@query("select action, min(id) as first_id from activity group by action", ("activity",))
def set3_ordered_distinct(a: Archive):
    return a.activity.groupBy("action").agg(F.min("id").alias("first_id"))


@query("select s.id, s.name, count(j.id) filter (j.status = 'error') as errors from sites s left join jobs j on j.site_id = s.id group by all", ("sites", "jobs"))
def dsh1_site_errors(a: Archive):
    bad = a.jobs.where("status = 'error'").groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("n"))
    return a.sites.select("id", "name").join(bad, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("errors"))


@query("select t.snapshot_id, count(*) as orphaned from assets t where t.snapshot_id not in (select id from snapshots) group by all", ("assets", "snapshots"))
def int1_orphaned_assets(a: Archive):
    return objects.referential_audit(a.snapshots, "id", a.assets.select("snapshot_id", "id"), "snapshot_id").groupBy("snapshot_id").agg(F.count("*").alias("orphaned"))


def link_edges(a: Archive):
    """src, pos, dst: links of pages to page-like addresses of the same host."""
    rows = a.raw("pages").select(F.col("page_id").alias("page"), urls.canonical_url(F.col("url"), "preserve").alias("src"), "url", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))
    found = rows.where(urls.followed(F.col("href"))).withColumn("target", urls.resolve(F.col("url"), F.col("href")))
    inside = found.where((urls.host_key(F.col("target")) == urls.host_key(F.col("url"))) & urls.looks_like_page(F.col("target")))
    return inside.select("src", "pos", urls.canonical_url(F.col("target"), "preserve").alias("dst"))


_HOST = "lower(split_part(split_part(url, '://', 2), '/', 1))"
_CANON = "split_part(url, '://', 1) || '://' || " + _HOST + " || regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '#.*$', '')"
_ENDINGS = "(?i)\\.(" + "|".join(e[1:] for e in urls.ASSET_ENDINGS) + ")$"
#: Links lead to the root of their page's host, as all of these pages' links do.
_EDGES = f"""(select src, pos, split_part(url, '://', 1) || '://' || {_HOST} || regexp_replace(href, '#.*$', '') as dst from (
    select url, {_CANON} as src, unnest(l) as href, (generate_subscripts(l, 1) - 1)::int as pos from (select url, regexp_extract_all(html, '(?is)<(?:a|area)\\b[^>]*?\\shref\\s*=\\s*"([^"]*)"', 1) as l from pages))
    where starts_with(href, '/') and not regexp_matches(split_part(split_part(href, '#', 1), '?', 1), '{_ENDINGS}'))"""


@query(f"select src, pos, dst from {_EDGES}")
def htm5_internal_links(a: Archive):
    return link_edges(a)


_CAP, _DEPTH = 12, 3
#: Pages of a host also lead to its next page, as a pager does.
_PAGED = f"""pg as (select page_id, {_HOST} as job, {_CANON} as url from pages), edges as (select src, pos, dst from {_EDGES} union all
    select * from (select url as src, -1 as pos, lead(url) over (partition by job order by page_id) as dst from pg) where dst is not null)"""


def _crawl_sql() -> str:
    """The levels one after another; each cuts at the cap."""
    parts = [_PAGED, f"k0 as (select job, url, 0 as depth, 1::bigint as rank from pg where page_id in (select min(page_id) from pg group by job))"]
    for d in range(1, _DEPTH + 1):
        known = " union all ".join(f"select * from k{i}" for i in range(d))
        parts += [
            f"f{d} as (select job, dst as url, min((rank, pos)) as o from k{d - 1} join edges on src = url group by job, dst)",
            f"k{d} as (select job, url, {d} as depth, rank from (select job, url, row_number() over (partition by job order by o) + (select count(*) from ({known}) k where k.job = f{d}.job) as rank from f{d} where (job, url) not in (select (job, url) from ({known}))) where rank <= {_CAP})",
        ]
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select job, rank::int as rank, url, depth from k{i}" for i in range(_DEPTH + 1))


@query(_crawl_sql())
def grf1_crawl_frontier(a: Archive):
    pages = a.raw("pages").select("page_id", F.lower(urls.netloc(F.col("url"))).alias("job"), urls.canonical_url(F.col("url"), "preserve").alias("url"))
    following = pages.select(F.col("url").alias("src"), F.lit(-1).alias("pos"), F.lead("url").over(Window.partitionBy("job").orderBy("page_id")).alias("dst")).where("dst is not null")
    starts = pages.groupBy("job").agg(F.min_by("url", "page_id").alias("url")).withColumn("pos", F.lit(0))
    return crawl.crawl(link_edges(a).unionByName(following), starts, _DEPTH, _CAP)


@query("select job_id, url, depth, n from (select job_id, url, min(depth) as depth, min(id) as i, row_number() over (partition by job_id order by min(id)) as n from attempts group by job_id, url) where n <= 3", ("attempts",))
def win4_capped_frontier(a: Archive):
    firsts = a.attempts.groupBy("job_id", "url").agg(F.min("depth").alias("depth"), F.min("id").alias("i"))
    return firsts.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("i"))).where("n <= 3").select("job_id", "url", "depth", "n")
