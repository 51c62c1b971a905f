"""Queries on addresses, policies, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, url_kernels, urls
from ..operators import policy
from ..sources.tables import Archive
from .registry import query

#: RFC 3986 parts as RE2 groups.
_P = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"
_N, _PATH, _Q = (f"regexp_extract(url, {_P}, {i})" for i in (2, 3, 4))
_SCHEME = f"lower(regexp_extract(url, {_P}, 1))"
_SLASH = f"if({_PATH} = '', '/', {_PATH})"


def _url(q: str) -> str:
    return f"{_SCHEME} || '://' || lower({_N}) || {_SLASH} || if({q} = '', '', '?' || {q})"


_SORTED = f"""array_to_string(list_sort(list_filter(string_split({_Q}, '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in
    ('fbclid','gclid','mc_cid','mc_eid','msclkid') and not starts_with(lower(split_part(p, '=', 1)), 'utm_'))), '&')"""


@query(f"select page_id, {_url(_SORTED)} as canonical from pages")
def url2_canonical(a: Archive):
    return a.raw("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"select page_id, {_url(_SORTED)} as canonical from pages")
def url2_canonical_decoded(a: Archive):
    return a.raw("pages").select("page_id", urls.canonical_decoded(F.col("url")).alias("canonical"))


@query(f"""select page_id, {_url("''")} as canonical from pages""")
def url3_canonical_dropped(a: Archive):
    return a.raw("pages").select("page_id", urls.canonical_url(F.col("url"), "drop").alias("canonical"))


@query(f"select page_id, {_SCHEME} || '://' || {_N} || {_PATH} || if({_Q} = '', '', '?' || {_Q}) as normal from pages")
def url1_normalized(a: Archive):
    return a.raw("pages").select("page_id", urls.normalize_url(F.concat(F.lit("  "), F.col("url"), F.lit(" "))).alias("normal"))


@query(f"select regexp_replace(lower({_N}), '^www\\.', '') as host, count(*) as n, min(page_id) as first_page from pages group by host")
def url4_host_keys(a: Archive):
    return a.raw("pages").groupBy(urls.host_key(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"select page_id, {_url(_Q)} as link_key from pages")
def url5_link_keys(a: Archive):
    return a.raw("pages").select("page_id", urls.replay_link_key(F.col("url")).alias("link_key"))


@query(f"select page_id, left(regexp_replace(lower({_N}), '^www\\.', ''), 160) as site_name from pages")
def url7_site_names(a: Archive):
    return a.raw("pages").select("page_id", urls.site_name(F.col("url")).alias("site_name"))


@query(
    f"""select page_id, left({_SCHEME} || '://' || lower({_N}) || {_PATH} || if({_Q} = '', '', '?' || array_to_string(list_transform(string_split({_Q}, '&'), lambda p: split_part(p, '=', 1) || '=redacted'), '&')), 1000) as safe from pages"""
)
def url8_diagnostic(a: Archive):
    return a.raw("pages").select("page_id", urls.diagnostic_url(F.col("url")).alias("safe"))


@query(
    f"""select page_id, left('failed at ' || {_SCHEME} || '://' || lower({_N}) || {_PATH} || if({_Q} = '', '', '?' || array_to_string(list_transform(string_split({_Q}, '&'), lambda p: split_part(p, '=', 1) || '=redacted'), '&'))
    || ' and ' || lower(regexp_extract(url, '^([^:]*)', 1)) || '://' || lower({_N}) || '/p?token=redacted twice', 240) as reason from pages"""
)
def url9_safe_reasons(a: Archive):
    secret = F.concat(F.regexp_replace("url", "^(https?)://([^/]*).*$", "$1://me:pw@$2"), F.lit("/p?token=abc"))
    reason = F.concat(F.lit("failed  at\n"), F.col("url"), F.lit(" \t and "), secret, F.lit(" twice"))
    return a.raw("pages").select("page_id", urls.safe_reason(reason).alias("reason"))


@query(f"select page_id, {_SCHEME} in ('http', 'https') and {_N} <> '' as ok from pages")
def url10_asset_urls(a: Archive):
    return a.raw("pages").select("page_id", urls.is_web(F.col("url")).alias("ok"))


@query("select page_id, 'https://web.archive.org/web/20240101000000id_/' || url as archived, url as original from pages")
def url11_archive_urls(a: Archive):
    made = urls.archive_capture_url(F.lit("20240101000000"), F.col("url"))
    return a.raw("pages").select("page_id", made.alias("archived"), urls.archived_original(made).alias("original"))


@query(rf"select page_id, not regexp_matches(lower({_PATH}), '\.(jpg|jpeg|png|gif|webp|svg|ico|pdf|zip|mp4|mp3|mov|avi|css|js|xml|json|woff|woff2|ttf|eot)$') as is_page from pages")
def flt12_page_suffix(a: Archive):
    return a.raw("pages").select("page_id", urls.looks_like_page(F.col("url")).alias("is_page"))


@query(
    f"""select page_id, (regexp_full_match(t, '/en/.*') or regexp_full_match(t, '/fr/.[0-9].*')) and not (regexp_full_match(t, '.*[?]page=.*') or regexp_full_match(t, '/en/[!1-3].*')
    or regexp_full_match(t, '/en/[^1-7].*')) as allowed from (select page_id, {_SLASH} || if({_Q} = '', '', '?' || {_Q}) as t from pages)"""
)
def flt11_policy(a: Archive):
    ok = urls.matches_policy(F.col("url"), ["/en/*", "/fr/?[0-9]*"], ["*[?]page=*", "/en/[!1-7]*", "/en/[1-3!]*"])
    return a.raw("pages").select("page_id", ok.alias("allowed"))


@query(f"select a.page_id from pages a where regexp_replace(lower(regexp_extract(a.url, {_P}, 2)), '^www\\.', '') = 'thther.example.org'")
def flt13_same_host(a: Archive):
    return a.raw("pages").where(urls.host_key(F.col("url")) == "thther.example.org").select("page_id")


#: Blocks of the IPv4 address space that are never fetched, and those that are private.
_BLOCKED, _PRIVATE = ("0.0.0.0/32", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "240.0.0.0/4"), (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
)


def _in_blocks(blocks) -> str:
    """Whether the number n lies in one of the blocks."""
    tests = []
    for b in blocks:
        base, bits = b.split("/")
        size = 1 << 32 - int(bits)
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
        tests.append(f"n between {low} and {low + size - 1}")
    return "(" + " or ".join(tests) + ")"


_ODD = "('0x' || substr(h, 1, 2))::int % 4 = 0"


@query(
    f"""select id, address, case when {_in_blocks(_BLOCKED)} then 'blocked' when {_in_blocks(_PRIVATE)} then 'private' else 'allowed' end as verdict from (
    select id, o[1] || '.' || o[2] || '.' || o[3] || '.' || o[4] as address, o[1]::bigint * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] as n from (
    select id, list_transform([if({_ODD}, '0x' || (array['0a', '64', '7f', 'a9', 'ac', 'c0', 'c6', 'cb'])[('0x' || substr(h, 3, 2))::int % 8 + 1], '0x' || substr(h, 3, 2)), if({_ODD}, '0x' || (array['40', '10', 'fe', 'a8', '00', '12', '33'])[('0x' || substr(h, 5, 2))::int % 7 + 1], '0x' || substr(h, 5, 2)),
      if({_ODD}, '0x' || (array['00', '02', '64', '71'])[('0x' || substr(h, 7, 2))::int % 4 + 1], '0x' || substr(h, 7, 2)), '0x' || substr(h, 9, 2)], lambda x: x::int) as o from (select id, sha256(url) as h from sites)))""",
    ("sites",),
)
def flt15_outbound(a: Archive):
    # addresses from digests of the sites' own; a quarter of them is moved near the special blocks
    h = F.sha2("url", 256)
    byte = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("int")
    near = lambda k, *values: F.when(byte(1) % 4 == 0, F.element_at(F.array(*map(F.lit, values)), byte(k) % len(values) + 1)).otherwise(byte(k)).cast("string")
    address = F.concat_ws(".", near(3, 10, 100, 127, 169, 172, 192, 198, 203), near(5, 64, 16, 254, 168, 0, 18, 51), near(7, 0, 2, 100, 113), byte(9).cast("string"))
    return a.sites.select("id", address.alias("address")).withColumn("verdict", url_kernels.outbound_verdict()(F.col("address")))


@query("select page_id, not regexp_matches(url, '^https?://[^/]+/(es|de)/') as allowed from pages")
def src13_robots(a: Archive):
    rules = "User-agent: *\nDisallow: /es/\nDisallow: /de/\n"
    return a.raw("pages").select("page_id", url_kernels.robots_allowed(rules)(F.col("url")).alias("allowed"))


@query("select id, case interval when 'daily' then 1 when 'weekly' then 7 when 'monthly' then 30 else 365 end as days from sites", ("sites",))
def dt1_interval_days(a: Archive):
    return a.sites.select("id", dates.interval_days(F.col("interval"), F.lit(None).cast("string")).alias("days"))


@query("select id, created_at + to_days(case when id % 2 = 0 then 7 else 365 end) as next_at from jobs", ("jobs",))
def dt2_next_after(a: Archive):
    days = dates.interval_days(F.when(F.col("id") % 2 == 0, "weekly").otherwise("yearly"), F.lit(None).cast("string"))
    return a.jobs.select("id", dates.next_after(F.col("created_at"), days).alias("next_at"))


@query(
    """select id, case when d + interval 9 hour > created_at then d + interval 9 hour else d + interval 33 hour end as daily,
    case when w + interval 9 hour > created_at then w + interval 9 hour else w + interval 177 hour end as weekly,
    case when m1 > created_at then m1 else m2 end as monthly
    from (select id, created_at, date_trunc('day', created_at)::timestamp as d, date_trunc('day', created_at)::timestamp + to_days(((6 - (isodow(created_at) - 1)) % 7 + 7)::int % 7) as w,
      date_trunc('month', created_at)::timestamp + to_days(least(31, day(last_day(created_at)))::int - 1) + interval 9 hour as m1,
      date_trunc('month', created_at)::timestamp + interval 1 month + to_days(least(31, day(last_day(created_at + interval 0 day - to_days(day(created_at)::int - 1) + interval 1 month)))::int - 1) + interval 9 hour as m2 from jobs)""",
    ("jobs",),
)
def dt3_next_calendar(a: Archive):
    t = F.col("created_at").cast("timestamp")
    at = lambda kind, **k: dates.next_calendar(t, kind, clock="09:00", **k).cast("timestamp_ntz").alias(kind)
    return a.jobs.select("id", at("daily"), at("weekly", weekday=6), at("monthly", month_day=31))


@query("select id, strftime(created_at, '%Y%m%d%H%M%S') as compact, date_trunc('second', created_at) as t, strftime(created_at, '%Y-%m-%d') as shown, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as wire from jobs", ("jobs",))
def dt4_compact_times(a: Archive):
    compact = F.date_format("created_at", "yyyyMMddHHmmss")
    return a.jobs.select("id", compact.alias("compact"), dates.sort_time(compact, F.col("created_at").cast("timestamp")).cast("timestamp_ntz").alias("t"), dates.display_date(compact).alias("shown"), dates.wire_time(F.col("created_at")).alias("wire"))


@query("select id, strftime(created_at, '%H:%M') >= '22:00' or strftime(created_at, '%H:%M') < '06:00' as night, strftime(created_at, '%H:%M') >= '09:00' and strftime(created_at, '%H:%M') < '17:00' as office from activity", ("activity",))
def flt10_window_open(a: Archive):
    t = F.col("created_at").cast("timestamp")
    return a.activity.select("id", dates.window_open(t, "22:00", "06:00").alias("night"), dates.window_open(t, "09:00", "17:00").alias("office"))


@query("select id, isodow(created_at) - 1 as weekday, day(created_at) as month_day from jobs", ("jobs",))
def dt10_weekdays(a: Archive):
    return a.jobs.select("id", F.weekday("created_at").cast("long").alias("weekday"), F.dayofmonth("created_at").cast("long").alias("month_day"))


@query("select id, if(status = 'error' or captured = 0, created_at + interval 6 hour, created_at) as next_at from jobs", ("jobs",))
def dt11_backoff(a: Archive):
    return a.jobs.select("id", policy.backoff(F.col("created_at"), (F.col("status") == "error") | (F.col("captured") == 0)).alias("next_at"))


@query(
    """select id, next_at from (select id, next_at, row_number() over (order by coalesce(strftime(next_at, '%Y-%m-%d %H:%M:%S'), ''), id) as r from sites
    where not paused and coalesce(next_at, timestamp '1970-01-01') <= timestamp '2024-06-01') where r <= 40""",
    ("sites",),
)
def sch1_due_sites(a: Archive):
    return policy.due_sites(a.sites, F.lit("2024-06-01").cast("timestamp_ntz"), 40).select("id", "next_at")


@query("select id, greatest(1, id % 60) * (8388608 + 4194304 * (id % 130)) as ceiling from sites", ("sites",))
def sch2_size_ceiling(a: Archive):
    return a.sites.select("id", policy.size_ceiling(F.col("id") % 60, F.lit(8 << 20), F.lit(4 << 20), F.col("id") % 130).alias("ceiling"))


@query(
    """select c_custkey as id, greatest(1.0, least(120.0, c_acctbal / 50)) as delay, greatest(5.0, least(120.0, c_acctbal / 10)) as timeout, if(c_mktsegment = 'BUILDING', 'owner_override', 'respect') as robots,
    case c_mktsegment when 'HOUSEHOLD' then 'drop' when 'FURNITURE' then 'preserve' else 'normalize' end as query_mode from customer"""
)
def sch3_policy_clamps(a: Archive):
    rows = a.raw("customer")
    robots = F.replace("c_mktsegment", F.lit("BUILDING"), F.lit("Owner_Override"))
    mode = F.replace(F.replace("c_mktsegment", F.lit("HOUSEHOLD"), F.lit("Drop")), F.lit("FURNITURE"), F.lit("PRESERVE"))
    clean = policy.normalized(F.col("c_acctbal") / 50, F.col("c_acctbal") / 10, robots, mode)
    return rows.select(F.col("c_custkey").alias("id"), *(clean[k].alias(k) for k in ("delay", "timeout", "robots", "query_mode")))


@query("select id, case when bytes < 1024 then bytes || ' B' when bytes < 1048576 then printf('%.1f KB', bytes / 1024.0) else printf('%.1f MB', bytes / 1048576.0) end as size from assets", ("assets",))
def str1_human_sizes(a: Archive):
    return a.assets.select("id", text.human_size(F.col("bytes")).alias("size"))


@query("select id, upper(left(name, 1)) || if(contains(name, ' '), upper(left(split_part(name, ' ', 2), 1)), '') as initials from users", ("users",))
def str2_initials(a: Archive):
    return a.users.select("id", text.initials(F.col("name")).alias("initials"))


@query("""select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from pages""")
def str3_escaped(a: Archive):
    return a.raw("pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query(
    """select doc_id, case when p = 0 then null else if(greatest(p - 90, 1) > 1, '…', '') || trim(substr(text, greatest(p - 90, 1), least(p + 94, length(text) + 1) - greatest(p - 90, 1))) ||
    if(least(p + 94, length(text) + 1) <= length(text), '…', '') end as excerpt from (select doc_id, text, instr(lower(text), 'heth') as p from documents)"""
)
def str4_excerpts(a: Archive):
    return a.raw("documents").select("doc_id", text.excerpt(F.col("text"), "heth").alias("excerpt"))


@query("select id, case when content_type = 'text/css' then 'css' when content_type = 'image/png' then 'image' else 'script' end as kind from assets", ("assets",))
def str6_asset_kinds(a: Archive):
    return a.assets.select("id", text.asset_kind(F.col("content_type")).alias("kind"))


@query("select id, digest, 'sha256:' || rtrim(replace(replace(base64(unhex(digest)), '+', '-'), '/', '_'), '=') as wire, digest as back from assets", ("assets",))
def hsh2_wire_digests(a: Archive):
    wire = text.digest_wire(F.col("digest"))
    return a.assets.select("id", "digest", wire.alias("wire"), text.digest_hex(wire).alias("back"))


@query("""select id, '{"bytes":' || bytes || ',"digest":"' || digest || '","folder":"' || folder || '"}' as json from assets""", ("assets",))
def jsn1_canonical_json(a: Archive):
    return a.assets.select("id", text.canonical_json(folder=F.col("folder"), digest=F.col("digest"), bytes=F.col("bytes")).alias("json"))
