"""Queries on single records, lookups, repairs, health, and the rest of the page and address functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, html, html_kernels, text, urls
from ..operators import compare, crawl, objects, policy, upkeep
from ..sources.tables import Archive
from .registry import query


@query("select id, name, owner_id from sites where id = 7", ("sites",))
def flt3_find_by_id(a: Archive):
    return a.sites.where("id = 7").select("id", "name", "owner_id").limit(1)


@query("select id, name from users where lower(email) = 'nation_3@example.test'", ("users",))
def flt3_find_by_email(a: Archive):
    return a.users.where(F.lower("email") == "Nation_3@Example.test".lower()).select("id", "name").limit(1)


@query("select id from sites where owner_id = 5", ("sites",))
def flt2_managed_sites(a: Archive):
    return a.sites.where("owner_id = 5").select("id")


@query("select id, contains(lower(coalesce(detail, '')), '\"k\": 1') or contains(lower(action), '\"k\": 1') as hit from activity", ("activity",))
def flt5_substring_search(a: Archive):
    return a.activity.select("id", text.contains_any(' "K": 1 ', F.col("detail"), F.col("action")).alias("hit"))


@query("select id from sites where not paused and coalesce(next_at, timestamp '1970-01-01') <= timestamp '2024-03-01'", ("sites",))
def flt9_due(a: Archive):
    return policy.due_sites(a.sites, F.lit("2024-03-01").cast("timestamp_ntz"), 1 << 30).select("id")


@query("select page_id, not regexp_matches(h, '^(#|mailto:|tel:|javascript:|data:)') as follow from (select page_id, (array['#top', 'mailto:a@b', 'Mailto:a', '/x', 'data:1', 'javascript:0', 'tel:1'])[page_id % 7 + 1] as h from pages)")
def flt14_followed(a: Archive):
    kinds = F.array(*map(F.lit, ("#top", "mailto:a@b", "Mailto:a", "/x", "data:1", "javascript:0", "tel:1")))
    return a.raw("pages").select("page_id", urls.followed(F.element_at(kinds, (F.col("page_id") % 7 + 1).cast("int"))).alias("follow"))


_HOPS = "case when contains(u, '://m.') then 'credentials' when contains(u, '.net/') then 'port' when not regexp_matches(u, '^https?://[^/]') then 'scheme' end"


@query(f"""select page_id, {_HOPS.replace('u,', 'url,')} as first_problem, {_HOPS.replace('u,', 'url,')} is null and starts_with(url, 'https') as allowed from pages""")
def flt16_redirects(a: Archive):
    # hosts below m. ask for a password, those in .net name a port that doesn't exist, and plain pages lead on to another scheme
    odd = F.replace(F.replace("url", F.lit("://m."), F.lit("://me:pw@m.")), F.lit(".net/"), F.lit(".net:99999/"))
    chain = F.array(odd, F.regexp_replace("url", "^http:", "ftp:"), F.lit("https://a.test/"))
    return a.raw("pages").select("page_id", urls.outbound_problem(odd).alias("first_problem"), urls.redirects_allowed(chain).alias("allowed"))


@query("select distinct s.run_id from snapshots s where s.run_id in (select run_id from jobs where status <> 'running')", ("snapshots", "jobs"))
def flt18_completed_runs(a: Archive):
    done = a.jobs.where("status <> 'running'").select("run_id")
    return a.snapshots.select("run_id").distinct().join(done, "run_id", "left_semi")


@query("""select event_id as id, json_extract(props, '$.k')::bigint as k, null::varchar as missing from events""")
def prj3_restored(a: Archive):
    return upkeep.restored(a.activity.select("id", "detail"), "detail", {"k": "bigint", "missing": "string"}).select("id", "k", "missing")


@query("""select id, '{"captured":' || captured || ',"failed":' || failed || '}' as extra from jobs""", ("jobs",))
def jsn2_overflow(a: Archive):
    return a.jobs.select("id", text.canonical_json(failed=F.col("failed"), captured=F.col("captured")).alias("extra"))


@query("select t.id, s.site_id, si.owner_id from assets t join snapshots s on s.id = t.snapshot_id join sites si on si.id = s.site_id where si.owner_id < 10", ("assets", "snapshots", "sites"))
def jn5_assets_of_owners(a: Archive):
    s = a.snapshots.select(F.col("id").alias("snapshot_id"), "site_id").join(a.sites.where("owner_id < 10").select(F.col("id").alias("site_id"), "owner_id"), "site_id")
    return a.assets.select("id", "snapshot_id").join(s, "snapshot_id").select("id", "site_id", "owner_id")


@query("select id, name, quota from users where quota is not null", ("users",))
def jn6_users_with_quotas(a: Archive):
    quotas = a.users.where("quota is not null").select("id", "quota")
    return a.users.select("id", "name").join(quotas, "id").select("id", "name", "quota")


@query("select distinct run_id from snapshots where run_id in (select run_id from jobs where status = 'error')", ("snapshots", "jobs"))
def jn10_runs_to_update(a: Archive):
    return a.snapshots.select("run_id").distinct().join(a.jobs.where("status = 'error'").select("run_id"), "run_id", "left_semi")


@query("select id from sites s where exists (select 1 from jobs j where j.site_id = s.id and j.auto_resume)", ("sites", "jobs"))
def jn11_sites_that_resume(a: Archive):
    return a.sites.select("id").join(a.jobs.where("auto_resume").select(F.col("site_id").alias("id")), "id", "left_semi")


@query("select count(*) as lost from snapshots where run_id not in (select run_id from jobs)", ("snapshots", "jobs"))
def jn20_runs_of_snapshots(a: Archive):
    return a.snapshots.join(a.jobs.select("run_id"), "run_id", "left_anti").agg(F.count("*").alias("lost"))


_ADDRESSED = "(select id, snapshot_id, 'https://a.test/' || id % 20 as source_url, if(id % 3 = 0, null, 'https://a.test/' || id % 15) as final_url from assets)"


def _addressed(a: Archive):
    url = lambda n: F.concat(F.lit("https://a.test/"), (F.col("id") % n).cast("string"))
    return a.assets.select("id", "snapshot_id", url(20).alias("source_url"), F.when(F.col("id") % 3 == 0, None).otherwise(url(15)).alias("final_url"))


@query(
    f"""select snapshot_id, url, arg_max(id, (pos, id)) as asset_id from (select snapshot_id, id, 0 as pos, source_url as url from {_ADDRESSED} union all
    select snapshot_id, id, 1, final_url from {_ADDRESSED}) where url is not null group by snapshot_id, url""",
    ("assets",),
)
def jn21_asset_lookup(a: Archive):
    return upkeep.asset_lookup(_addressed(a))


@query(
    """select coalesce(l.key, r.key) as key, case when l.key is null then 'added' when r.key is null then 'removed' when l.d = r.d then 'unchanged' else 'changed' end as change
    from (select folder || ' :: ' || bytes as key, arg_max(digest, id) as d from assets where id in (select doc_id from labels where quality = 1) group by key) l
    full join (select folder || ' :: ' || bytes as key, arg_max(digest, id) as d from assets where id not in (select doc_id from labels where quality = 1) group by key) r on l.key = r.key""",
    ("assets",),
)
def jn16_resource_diff(a: Archive):
    # one capture holds the documents judged good, the other all the rest
    good = a.raw("labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    side = lambda how: compare.keyed(a.assets.join(good, "id", how), F.concat_ws(" :: ", "folder", F.col("bytes").cast("string")), F.col("digest"))
    return compare.changes(side("left_semi"), side("left_anti"))


@query("select job_id, url, max(n) + 1 as next_number from (select job_id, url, row_number() over (partition by job_id, url order by id) as n from attempts) group by job_id, url", ("attempts",))
def agg9_next_attempt(a: Archive):
    return a.attempts.groupBy("job_id", "url").agg((F.count("*") + 1).alias("next_number"))


@query("select id, count(*) over () as total from (select id from jobs where status = 'complete') order by id limit 25", ("jobs",))
def agg16_page_with_total(a: Archive):
    hit = a.jobs.where("status = 'complete'")
    return hit.select("id").orderBy("id").limit(25).crossJoin(hit.agg(F.count("*").alias("total")))  # one row


@query("select snapshot_id, arg_min(id, (len(regexp_extract_all(body, '(?i)url\\(')), id)) as id from assets where content_type = 'text/css' group by snapshot_id", ("assets",))
def agg19_lightest_stylesheet(a: Archive):
    return upkeep.lightest_stylesheet(a.assets)


@query("select site_id, max(created_at) as latest from snapshots group by site_id", ("snapshots",))
def agg20_latest_run_start(a: Archive):
    return a.snapshots.groupBy("site_id").agg(F.max("created_at").alias("latest"))


@query("select snapshot_id, sum(bytes)::bigint as bytes from assets group by snapshot_id", ("assets",))
def agg21_required_bytes(a: Archive):
    return upkeep.required_bytes(a.assets)


@query("select ((select count(*) from users) + (select count(*) from sites) + (select count(*) from snapshots) + (select count(*) from activity))::bigint as rows", ("users", "sites", "snapshots", "activity"))
def agg23_rows_in_all(a: Archive):
    return upkeep.emptiness(a.users, a.sites, a.snapshots, a.activity)


@query("select run_id, count(*) as pages, min(id) as entry_id, arg_min(source_url, id) as entry_url from snapshots group by run_id", ("snapshots",))
def agg26_run_entries(a: Archive):
    return a.snapshots.groupBy("run_id").agg(F.count("*").alias("pages"), F.min("id").alias("entry_id"), F.min_by("source_url", "id").alias("entry_url"))


@query("select (select count(*) from jobs) as jobs, (select count(distinct run_id) from snapshots) as runs, (select count(*) from users) > 0 as set_up, (select count(*) from users) = 0 as open", ("jobs", "snapshots", "users"))
def agg27_storage_health(a: Archive):
    return upkeep.storage_health(a.jobs, a.snapshots, a.users)


_NUMBERED = "(select id, snapshot_id, content_type, 'asset_' || lpad((id % 40)::varchar, 3, '0') as asset_id from assets)"
_RENUMBERED = f"""(select *, if(again, 'asset_' || if(top + n < 1000, lpad((top + n)::varchar, 3, '0'), (top + n)::varchar), asset_id) as new_id from (
    select *, row_number() over (partition by snapshot_id, again order by id) as n, max(regexp_extract(asset_id, '(\\d+)', 1)::bigint) over (partition by snapshot_id) as top from (
    select *, row_number() over (partition by snapshot_id, asset_id order by id) > 1 as again from {_NUMBERED})))"""


def _numbered(a: Archive):
    return a.assets.select("id", "snapshot_id", "content_type", F.concat(F.lit("asset_"), F.lpad((F.col("id") % 40).cast("string"), 3, "0")).alias("asset_id"))


@query(f"select id, snapshot_id, asset_id, new_id from {_RENUMBERED}", ("assets",))
def ded4_renumbered_assets(a: Archive):
    return upkeep.renumbered(_numbered(a)).select("id", "snapshot_id", "asset_id", "new_id")


@query(f"select snapshot_id, asset_id, case content_type when 'text/css' then 'css' when 'image/png' then 'image' else 'script' end as kind, arg_min(new_id, id) as means from {_RENUMBERED} group by all", ("assets",))
def htm18_preferred_assets(a: Archive):
    return upkeep.preferred(_numbered(a))


@query("select snapshot_id, max(regexp_extract('asset_' || id, '(\\d+)', 1)::bigint) + 1 as next_number from assets group by snapshot_id", ("assets",))
def win9_next_asset_number(a: Archive):
    n = text.asset_number(F.concat(F.lit("asset_"), F.col("id").cast("string")))
    return a.assets.groupBy("snapshot_id").agg((F.max(n) + 1).alias("next_number"))


@query("select run_id, min(created_at) as started_at, count(*) as jobs from jobs group by run_id order by started_at desc, run_id desc limit 30", ("jobs",))
def srt1_latest_runs(a: Archive):
    runs = a.jobs.groupBy("run_id").agg(F.min("created_at").alias("started_at"), F.count("*").alias("jobs"))
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(max(0, 30))


@query("select id, created_at from jobs where status = 'interrupted' order by created_at, id limit 12", ("jobs",))
def srt6_oldest_first(a: Archive):
    return a.jobs.where("status = 'interrupted'").select("id", "created_at").orderBy("created_at", "id").limit(12)


@query("select id, row_number() over (order by created_at desc, id) as place from snapshots order by created_at desc, id limit 500", ("snapshots",))
def srt8_newest_pages(a: Archive):
    top = a.snapshots.select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(500)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).alias("place"))  # 500 rows


@query("select run_id, id, row_number() over (partition by run_id order by source_url, id) as place from snapshots", ("snapshots",))
def srt9_pages_of_run(a: Archive):
    return a.snapshots.select("run_id", "id", F.row_number().over(Window.partitionBy("run_id").orderBy("source_url", "id")).alias("place"))


@query("select site_id, run_id, row_number() over (partition by site_id order by min(created_at), run_id) as place from jobs group by site_id, run_id", ("jobs",))
def srt12_runs_for_import(a: Archive):
    runs = a.jobs.groupBy("site_id", "run_id").agg(F.min("created_at").alias("t"))
    return runs.select("site_id", "run_id", F.row_number().over(Window.partitionBy("site_id").orderBy("t", "run_id")).alias("place"))


@query("select digest from snapshots union select t.digest from assets t join snapshots s on s.id = t.snapshot_id", ("assets", "snapshots"))
def set4_protected_digests(a: Archive):
    made = objects.manifests(a.snapshots, a.assets)
    return objects.protected(made.where(objects.valid_manifest(F.col("pages"), F.col("resources"))))


@query("select (select sum(bytes) from snapshots)::bigint + (select sum(bytes) from assets)::bigint as used", ("snapshots", "assets"))
def set5_total_usage(a: Archive):
    both = a.snapshots.select("bytes").unionByName(a.assets.select("bytes"))
    return both.agg(F.sum("bytes").alias("used"))


@query(
    """select page_id, len(list_intersect(list_filter(string_split_regex(lower(trim(array_to_string(regexp_extract_all(html, '<a href="/([^"]*)"', 1), ' '))), '\\s+'), lambda x: x <> ''), ['the', 'de', 'para', 'nicht', 'und'])) > 0 as loads
    from pages"""
)
def set6_link_relations(a: Archive):
    rel = F.array_join(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), " ")
    return a.raw("pages").select("page_id", html.has_relation(rel, ("the", "de", "para", "nicht", "und")).alias("loads"))


@query("select event_id as id, value <= 5 as exact, list_sort(json_keys(if(value > 5, replace(props, '}', ', \"value\": 1}'), props))) = ['k', 'value'] as both from events")
def set7_exact_keys(a: Archive):
    json = F.when(F.col("value") > 5, F.replace("detail", F.lit("}"), F.lit(', "value": 1}'))).otherwise(F.col("detail"))
    return a.activity.select("id", text.exact_keys(json, ["k"]).alias("exact"), text.exact_keys(json, ["value", "k"]).alias("both"))


@query(
    """select id, if(contains(seg, '.'), '.' || split_part(seg, '.', -1), if(content_type = 'application/json', '.json', '.html')) as ext from (
    select id, content_type, string_split(rtrim(split_part(split_part(regexp_replace(source_url, '^https?://[^/?#]*', ''), '#', 1), '?', 1), '/'), '/')[-1] as seg from snapshots)""",
    ("snapshots",),
)
def url13_asset_extensions(a: Archive):
    return a.snapshots.select("id", urls.asset_extension(F.col("source_url"), F.col("content_type")).alias("ext"))


@query("""select page_id, '/' || regexp_replace(url, '^https?://[^/]*/', '') as local, '/dashboard' as other, if(starts_with(url, 'https'), '/' || split_part(url, '/', 3), '/dashboard') as mixed from pages""")
def url14_local_returns(a: Archive):
    inside = F.regexp_replace("url", "^https?://[^/]*", " ")
    mixed = F.concat(F.when(F.col("url").startswith("https"), F.lit("/")).otherwise(F.lit("//")), F.split_part("url", F.lit("/"), F.lit(3)))
    return a.raw("pages").select("page_id", urls.local_return(inside).alias("local"), urls.local_return(F.col("url")).alias("other"), urls.local_return(mixed).alias("mixed"))


@query("select id, ['/a' || id, '/b'] as patterns from sites", ("sites",))
def url15_patterns(a: Archive):
    return a.sites.select("id", urls.split_patterns(F.concat(F.lit(" /a"), F.col("id").cast("string"), F.lit(" ,\n\n/b\n,"))).alias("patterns"))


#: Each link of a page as a reference of another kind, by its place, from the page's folder or the one above it.
_SITE, _PATH = "regexp_extract(url, '^[^/]*//[^/]*', 0)", "regexp_extract(url, '^[^/]*//[^/]*([^?#]*)', 1)"
_KINDS = f"""case pos % 10 when 0 then {_SITE} || h when 1 then {_SITE} || regexp_replace(folder, '[^/]*/$', '') || substr(h, 2) when 2 then {_SITE} || folder || substr(h, 2) when 3 then {_SITE} || {_PATH} || '?q=' || substr(h, 2)
    when 4 then url when 5 then split_part(url, ':', 1) || '://other.test' || h when 6 then split_part(url, '#', 1) || '#' || substr(h, 2) when 7 then {_SITE} || folder || substr(h, 2) || '/' when 8 then 'mailto:' || substr(h, 2) else 'ftp://files.test' || h end"""


@query(
    f"""select page_id, pos, {_KINDS} as target from (select page_id, url, regexp_extract({_PATH}, '^(.*/)', 1) as folder, unnest(l) as h, (generate_subscripts(l, 1) - 1)::int as pos
    from (select page_id, url, list_concat(l, list_reverse(l)) as l from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages)))"""
)
def url6_joined(a: Archive):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = a.raw("pages").select("page_id", "url", links.alias("links")).select("page_id", "url", F.posexplode(F.concat("links", F.reverse("links"))).alias("pos", "h"))
    rest, kind = F.substring("h", F.lit(2), F.length("h")), F.col("pos") % 10
    ref = (
        F.when(kind == 0, F.col("h")).when(kind == 1, F.concat(F.lit(".."), F.col("h"))).when(kind == 2, F.concat(F.lit("./"), rest)).when(kind == 3, F.concat(F.lit("?q="), rest)).when(kind == 4, F.lit(" "))
        .when(kind == 5, F.concat(F.lit("//other.test"), F.col("h"))).when(kind == 6, F.concat(F.lit("#"), rest)).when(kind == 7, F.concat(F.lit("a/../b/.././/"), rest, F.lit("/x/..")))
        .when(kind == 8, F.concat(F.lit("mailto:"), rest)).otherwise(F.concat(F.lit("ftp://files.test"), F.col("h")))
    )
    return rows.select("page_id", "pos", urls.resolve(F.col("url"), ref).alias("target"))


_SEGMENT = "string_split(split_part(split_part(url, '#', 1), '?', 1), '/')[-1]"


@query(f"select page_id, if(regexp_full_match({_SEGMENT}, '[0-9]+'), {_SEGMENT}::bigint, null) as number from pages")
def str5_asset_numbers(a: Archive):
    last = F.element_at(F.split(urls.path(F.col("url")), "/"), -1)
    return a.raw("pages").select("page_id", text.asset_number(F.concat(F.lit("asset_"), last)).alias("number"))


@query("select doc_id, sha256(text) as digest from documents")
def hsh1_digests(a: Archive):
    return a.raw("documents").select("doc_id", text.sha256_hex(F.col("text")).alias("digest"))


@query("select user_id as actor_id, min(ts) as first_at, date_trunc('second', max(ts)) as last_at, sum(epoch_us(ts) // 1000000)::bigint as seconds from events group by user_id")
def dt9_durations(a: Archive):
    return a.activity.groupBy("actor_id").agg(F.min("created_at").alias("first_at"), F.date_trunc("second", F.max("created_at")).cast("timestamp_ntz").alias("last_at"), F.sum(F.expr("div(unix_micros(cast(created_at as timestamp)), 1000000)")).alias("seconds"))


@query(
    """select id, hour(created_at) || ':' || minute(created_at) as clock, hour(created_at) >= 10 and minute(created_at) >= 10 as valid_clock, 'Etc/GMT-' || hour(created_at) as zone, hour(created_at) <= 14 as valid_zone from activity""",
    ("activity",),
)
def dt8_valid_clocks(a: Archive):
    clock = F.concat(F.hour("created_at").cast("string"), F.lit(":"), F.minute("created_at").cast("string"))
    zone = F.concat(F.lit("Etc/GMT-"), F.hour("created_at").cast("string"))
    return a.activity.select("id", clock.alias("clock"), dates.valid_clock(clock).alias("valid_clock"), zone.alias("zone"), dates.valid_zone(zone).alias("valid_zone"))


@query(r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) as body from pages")
def htm3_visible_without_templates(a: Archive):
    page = F.concat(F.col("html"), F.lit("<template><p>hidden</p></template>"))
    return a.raw("pages").select("page_id", html.visible_text(page, templates=True).alias("body"))


@query("select id as snapshot_id, 'evidence_' || k as id, if(k = 'screenshot', 'image/png', 'application/pdf') as content_type from snapshots, (select unnest(['screenshot', 'pdf']) as k)", ("snapshots",))
def htm20_evidence(a: Archive):
    kinds = F.explode(F.array(F.lit("screenshot"), F.lit("pdf"))).alias("k")
    rows = a.snapshots.select(F.col("id").alias("snapshot_id"), kinds)
    return rows.select("snapshot_id", F.concat(F.lit("evidence_"), F.col("k")).alias("id"), F.when(F.col("k") == "screenshot", "image/png").otherwise("application/pdf").alias("content_type"))


@query(
    """select j.id as job_id, u.url, if(u.url is null, 'no starting address is permitted', null) as problem from jobs j left join (
      select job_id, url from (select job_id, url, row_number() over (partition by job_id order by first) as n from (
        select j.id as job_id, lower(t.url) as url, min(t.id) as first from jobs j join attempts t on t.job_id = j.retry_of where t.status = 'failed' group by all)) where n <= 2 and not contains(url, '/p1')
      union all select id, 'https://site.test/home' from jobs where kind <> 'scheduled' and (retry_of is null or retry_of not in (select job_id from attempts where status = 'failed'))) u on u.job_id = j.id""",
    ("jobs", "attempts"),
)
def grf2_seeds(a: Archive):
    # scheduled jobs start at their site's own address, which is of another host than the one crawled
    start = F.when(F.col("kind") == "scheduled", F.concat(F.lit("https://site-"), F.col("site_id").cast("string"), F.lit(".test/")))
    jobs = a.jobs.select(F.col("id").alias("job_id"), F.col("retry_of").alias("retried"), start.alias("start_url"), F.lit("HTTPS://www.Site.test/home?a=1").alias("site_url"))
    failed = a.attempts.where("status = 'failed'").select(F.col("job_id").alias("retried"), F.upper(F.substring("url", 1, 5)).alias("scheme"), F.col("url"), F.col("id").alias("pos"))
    failed = failed.select("retried", F.concat("scheme", F.substring("url", 6, 1000)).alias("url"), "pos")
    return crawl.seeds(jobs, failed, 2, "drop", [], ["/p1*"]).select("job_id", F.regexp_replace("url", r"//www\.", "//").alias("url"), "problem")


@query("select id, status, if(id % 4 = 0 and status = 'running', true, false) as cancel_requested from jobs", ("jobs",))
def job5_cancel_flags(a: Archive):
    return a.jobs.select("id", "status", ((F.col("id") % 4 == 0) & (F.col("status") == "running")).alias("cancel_requested"))


@query("select id, site_id, bytes from snapshots where contains(lower(content_type), 'text/html') and kind <> 'wayback' order by id", ("snapshots",))
def job11_pages_to_localize(a: Archive):
    return a.snapshots.where(F.lower("content_type").contains("text/html") & (F.col("kind") != "wayback")).select("id", "site_id", "bytes")


@query("select id, least(5, id % 7 + 1) as depth, least(40, id % 90) as max_pages from snapshots where contains(content_type, 'html')", ("snapshots",))
def msc14_deeper(a: Archive):
    return upkeep.deeper(a.snapshots, F.col("id") % 7, F.col("id") % 90).select("id", "depth", "max_pages")


@query(
    """select actor_id, count(*) filter (action = 'click') as clicks, count(*) filter (action = 'error') as errors, least(120, count(*)) as kept, greatest(0, count(*) - 120) as cut,
    arg_min(id, (if(isodow(created_at) < 4, 0, 1), id)) as first_item from activity group by actor_id""",
    ("activity",),
)
def msc7_merged_diagnostics(a: Archive):
    # two records of each actor, from the first and the second half of the week
    rows = a.activity.select("actor_id", "id", "action", (F.weekday("created_at") >= 3).alias("late"))
    return upkeep.merged_records(rows, "actor_id", "late", "action", "id").select(
        "actor_id", F.coalesce(F.col("counts")["click"], F.lit(0)).alias("clicks"), F.coalesce(F.col("counts")["error"], F.lit(0)).alias("errors"),
        F.size("items").cast("long").alias("kept"), "cut", F.col("items")[0].alias("first_item"),
    )


@query("select id, sha256('job_' || id) as opaque from jobs", ("jobs",))
def msc19_opaque_ids(a: Archive):
    return a.jobs.select("id", F.sha2(F.concat(F.lit("job_"), F.col("id").cast("string")), 256).alias("opaque"))


@query("select snapshot_id, id, '/snapshots/' || snapshot_id || '/asset/' || id as url, id::varchar as parsed from assets", ("assets",))
def msc13_local_urls(a: Archive):
    url = F.concat(F.lit("/snapshots/"), F.col("snapshot_id").cast("string"), F.lit("/asset/"), F.col("id").cast("string"))
    return a.assets.select("snapshot_id", "id", url.alias("url"), F.regexp_extract(url, "^/snapshots/[^/]+/asset/([^/?#]+)", 1).alias("parsed"))


@query("select id, if(quota is null, 'Unlimited', printf('%.1f GB', quota / 1073741824.0)) as shown from users", ("users",))
def msc18_quota_labels(a: Archive):
    return a.users.select("id", F.when(F.col("quota").isNull(), "Unlimited").otherwise(text.human_size(F.col("quota"))).alias("shown"))


@query(
    """select s.id, if(c_acctbal / 1000 <= 2, 5.0, c_acctbal / 1000) as delay, if(s.id % 100 = 80, 25, s.id % 100) as pages,
    coalesce(j.last + to_days(case interval when 'daily' then 1 when 'weekly' then 7 when 'monthly' then 30 else 365 end), s.next_at) as next_at
    from sites s join customer c on c.c_custkey = s.id left join (select site_id, max(finished_at) as last from jobs group by site_id) j on j.site_id = s.id""",
    ("sites", "jobs"),
)
def msc6_migrated_policies(a: Archive):
    old = a.raw("customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("delay"), (F.col("c_custkey") % 100).alias("pages"))
    last = a.jobs.groupBy(F.col("site_id").alias("id")).agg(F.max("finished_at").alias("last"))
    rows = a.sites.select("id", "interval", "next_at").join(old, "id").join(last, "id", "left")
    return policy.migrated(rows).select("id", "delay", "pages", "next_at")


@query("select s.run_id, count(*) as pages from snapshots s where s.run_id in (select run_id from jobs where status = 'complete') group by s.run_id", ("snapshots", "jobs"))
def int6_runs_without_manifest(a: Archive):
    done = a.jobs.where("status = 'complete'").select("run_id")
    return a.snapshots.join(done, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("pages"))


@query(
    """select u.id, list_concat(if(coalesce(used, 0) * 100.0 > 5000000000 * 90.0 / 100, ['disk'], []), if(coalesce(broken, 0) > 0, ['failures'], [])) as alerts from users u
    left join (select s.owner_id, sum(j.reserved) as used from jobs j join sites s on s.id = j.site_id where j.status = 'complete' group by s.owner_id) k on k.owner_id = u.id
    left join (select s.owner_id, count(*) as broken from (select site_id, arg_max(status, (created_at, id)) as status from jobs group by site_id) j join sites s on s.id = j.site_id where j.status = 'error' group by s.owner_id) b on b.owner_id = u.id""",
    ("users", "sites", "jobs"),
)
def ops1_alerts(a: Archive):
    owned = a.sites.select(F.col("id").alias("site_id"), "owner_id")
    used = a.jobs.where("status = 'complete'").groupBy("site_id").agg(F.sum("reserved").alias("n")).join(owned, "site_id").groupBy("owner_id").agg(F.sum("n").alias("used"))
    latest = a.jobs.groupBy("site_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("status")).where("status = 'error'")
    broken = latest.join(owned, "site_id").groupBy("owner_id").agg(F.count("*").alias("broken"))
    rows = a.users.select(F.col("id").alias("owner_id")).join(used, "owner_id", "left").join(broken, "owner_id", "left")
    room = 50_000_000
    alerts = upkeep.operations_check(room - F.coalesce("used", F.lit(0)), F.lit(room), 10.0, F.coalesce("broken", F.lit(0)))
    return rows.select(F.col("owner_id").alias("id"), alerts.alias("alerts"))


@query(
    """select page_id, '@import "https://a.test/local/' || l[1] || '"; ' || array_to_string(list_transform(l, lambda x: 'a{background:url("https://a.test/local/' || x || '")}'), '') as style
    from (select page_id, list_transform(list_filter(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda x: x <> ''), lambda x: x) as l from pages) where len(l) > 0"""
)
def htm10_rewritten_styles(a: Archive):
    @F.pandas_udf("string")
    def rewritten(bodies):
        return bodies.map(lambda b: html_kernels.css(b, "https://a.test/x/", lambda u: u.replace("a.test/", "a.test/local/")), na_action="ignore")

    names = F.filter(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda x: x != "")
    style = F.concat(F.lit("@import '/"), F.col("names")[0], F.lit("'; "), F.array_join(F.transform("names", lambda x: F.concat(F.lit("a{background:url( /"), x, F.lit(")}"))), ""))
    return a.raw("pages").select("page_id", names.alias("names")).where(F.size("names") > 0).select("page_id", rewritten(style).alias("style"))


@query("select job_id, url from attempts group by job_id, url having bool_or(status = 'captured') or not regexp_matches(url, '^https?://[^/]+/p1')", ("attempts",))
def grf3_allowed_frontier(a: Archive):
    from ..functions.url_kernels import robots_allowed

    tried = a.attempts.groupBy("job_id", "url").agg(F.bool_or(F.col("status") == "captured").alias("kept"))
    allowed = robots_allowed("User-agent: *\nDisallow: /p1")(F.col("url"))  # a page that is already kept isn't asked for
    return tried.withColumn("allowed", allowed).where("kept or allowed").select("job_id", "url")


@query("select a.job_id, count(*) as reused from attempts a join snapshots s on s.id = a.snapshot_id where a.status = 'captured' group by a.job_id", ("attempts", "snapshots"))
def grf4_reused_snapshots(a: Archive):
    found = a.attempts.where("status = 'captured'").join(a.snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")
    return found.groupBy("job_id").agg(F.count("*").alias("reused"))


@query("select id, next_at from sites where id % 2 = 0 and not paused and coalesce(next_at, timestamp '1970-01-01') <= timestamp '2024-06-01'", ("sites",))
def sch1_changed_sites(a: Archive):
    digests = a.sites.select(F.col("id").alias("site_id"), F.lit("a").alias("last_digest"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("current_digest"))
    return policy.schedule(a.sites, F.lit("2024-06-01").cast("timestamp_ntz"), 1 << 30, digests).select("id", "next_at")


@query(
    """select (select count(*) from assets where snapshot_id not in (select id from snapshots)) as orphaned, (select count(*) from snapshots where id not in (select snapshot_id from assets)) as without_assets,
    (select count(*) from assets where bytes = 0) as empty, (select count(*) from assets where snapshot_id not in (select id from snapshots)) = 0 and (select count(*) from assets where bytes = 0) = 0 as ok""",
    ("assets", "snapshots"),
)
def int1_inspection(a: Archive):
    keys = a.snapshots.select(F.col("id").alias("snapshot_id"))
    orphaned = a.assets.select("snapshot_id").join(keys, "snapshot_id", "left_anti").agg(F.count("*").alias("orphaned"))
    bare = keys.join(a.assets.select("snapshot_id"), "snapshot_id", "left_anti").agg(F.count("*").alias("without_assets"))
    empty = a.assets.agg(F.count_if(F.col("bytes") == 0).alias("empty"))
    return orphaned.crossJoin(bare).crossJoin(empty).withColumn("ok", (F.col("orphaned") == 0) & (F.col("empty") == 0))  # single rows


@query("select digest, min(id) as first_id, count(*) as n, list_sort(list_distinct(list(folder))) as folders from assets group by digest", ("assets",))
def snk8_asset_index(a: Archive):
    return a.assets.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.array_sort(F.collect_set("folder")).alias("folders"))


@query("select t.id, s.site_id, si.name from assets t join snapshots s on s.id = t.snapshot_id join sites si on si.id = s.site_id", ("assets", "snapshots", "sites"))
def jn13_asset_sites(a: Archive):
    s = a.snapshots.select(F.col("id").alias("snapshot_id"), "site_id")
    return a.assets.select("id", "snapshot_id").join(s, "snapshot_id").join(a.sites.select(F.col("id").alias("site_id"), "name"), "site_id").select("id", "site_id", "name")


@query("select id, coalesce(used + reserved + 1000000 > quota, false) as refused, greatest(0, quota - used - reserved) * if(quota is null, null, 1) as available from (select id, quota, id * 10000000000 as used, id * 5000000000 as reserved from users)", ("users",))
def msc4_assert_available(a: Archive):
    from ..operators.quota import quota_columns

    used, reserved = F.col("id") * 10_000_000_000, F.col("id") * 5_000_000_000
    cols = quota_columns(F.col("quota"), used, reserved)
    return a.users.select("id", F.coalesce(used + reserved + 1_000_000 > F.col("quota"), F.lit(False)).alias("refused"), cols["available"].alias("available"))


@query("select id, greatest(1, least(32, id % 50 - 5)) as slots, id % 50 - 5 between 1 and 32 as valid from sites", ("sites",))
def msc5_scheduler_settings(a: Archive):
    n = F.col("id") % 50 - 5
    return a.sites.select("id", F.greatest(F.lit(1), F.least(F.lit(32), n)).alias("slots"), n.between(1, 32).alias("valid"))


@query("select id, greatest(0, least(5, id % 9 - 2)) as depth, greatest(1, least(500, id % 700)) as pages from sites", ("sites",))
def msc15_form_clamps(a: Archive):
    bounded = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    return a.sites.select("id", bounded(F.col("id") % 9 - 2, 0, 5).alias("depth"), bounded(F.col("id") % 700, 1, 500).alias("pages"))


@query("select id, digest from assets where snapshot_id = 4 order by id limit 1", ("assets",))
def msc16_first_asset(a: Archive):
    return a.assets.where("snapshot_id = 4").select("id", "digest").orderBy("id").limit(1)


@query("select count(*) = 0 as open from users", ("users",))
def msc17_registration_open(a: Archive):
    return a.users.agg((F.count("*") == 0).alias("open"))


@query("select s.id, count(j.id) as jobs, count(j.id) filter (j.status = 'complete') as complete from sites s left join jobs j on j.site_id = s.id where s.visibility = 'public' group by s.id", ("sites", "jobs"))
def msc11_exportable_sites(a: Archive):
    n = a.jobs.groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "complete").alias("complete"))
    rows = a.sites.where("visibility = 'public'").select("id").join(n, "id", "left")
    return rows.select("id", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("complete", F.lit(0)).alias("complete"))


@query("select event_id as id, contains(lower(props), lower('_%')) as hit from events")
def str8_literal_wildcards(a: Archive):
    return a.activity.select("id", text.contains_any("_%", F.col("detail")).alias("hit"))


@query("select id, url is not null and regexp_matches(url, '^https://www\\.[^/]+\\.test/$') as live from sites", ("sites",))
def url12_history_urls(a: Archive):
    return a.sites.select("id", urls.archive_history_url(F.col("url")).startswith("https://web.archive.org/web/*/https://www.").alias("live"))
