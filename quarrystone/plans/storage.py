"""Queries on quotas, objects, manifests, integrity and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml, objects, quota
from ..sources.tables import VIEWS_SQL, Archive
from .registry import SQL, query


@query(
    """select count(*) filter (digest is not null) as "references", count(distinct digest) as unique_objects, sum(bytes)::bigint as logical_bytes,
    (select sum(b)::bigint from (select arg_min(bytes, id) as b from assets group by digest)) as unique_bytes, count(*) filter (digest is null) as missing,
    sum(bytes)::bigint - (select sum(b)::bigint from (select arg_min(bytes, id) as b from assets group by digest)) as saved_bytes, count(*) - count(distinct digest) as duplicate_references from assets""",
    ("assets",),
)
def ded1_asset_dedup_report(a: Archive):
    return objects.dedup_report(a.assets)


_USAGE = """per as (select snapshot_id, sum(bytes)::bigint as b from assets group by snapshot_id),
    tot as (select s.site_id, sum(s.bytes + coalesce(per.b, 0))::bigint as b from snapshots s left join per on per.snapshot_id = s.id group by s.site_id),
    used as (select owner_id, sum(b)::bigint as used from tot join sites on sites.id = tot.site_id group by owner_id),
    res as (select s.owner_id, sum(j.reserved)::bigint as reserved from jobs j join sites s on s.id = j.site_id where j.status = 'running' or (j.status = 'interrupted' and j.auto_resume) group by s.owner_id),
    rep as (select u.id as owner_id, u.name, u.quota, coalesce(used, 0) as used, coalesce(reserved, 0) as reserved from users u left join used on used.owner_id = u.id left join res on res.owner_id = u.id)"""
_V = ("users", "sites", "snapshots", "assets", "jobs")


@query("")
def agg11_owner_usage(a: Archive):
    return quota.owner_usage(a.users, a.sites, a.snapshots, a.assets)


@query("")
def agg12_reservations(a: Archive):
    return quota.reservations(a.sites, a.jobs)


def _report(a: Archive):
    return quota.quota_report(a.users, quota.owner_usage(a.users, a.sites, a.snapshots, a.assets), quota.reservations(a.sites, a.jobs))


@query("")
def agg13_quota_report(a: Archive):
    return _report(a).select("owner_id", "name", "quota", "used", "reserved", "committed", "available", F.round("percent_committed", 6).alias("percent_committed"), "warning", "over")


@query("")
def agg14_capacity(a: Archive):
    total = _report(a).agg(F.sum("used").alias("used"), F.sum("reserved").alias("reserved"))
    cols = quota.quota_columns(F.lit(10_000_000_000).cast("long"), F.col("used"), F.col("reserved"))
    return total.select("used", "reserved", cols["available"].alias("available"), cols["over"].alias("over"))


@query("")
def agg15_quota_summaries(a: Archive):
    return _report(a).where("quota is not null").orderBy(F.lower("name"), F.lower("email")).select("owner_id", "name", "quota", "used")


@query("")
def job1_admission(a: Archive):
    requests = a.sites.select(F.col("id").alias("site_id"), "owner_id", (F.col("id") * 1_000_000_000).alias("required"))
    return quota.admission(requests, a.jobs, _report(a), 1_000_000_000).select("site_id", "owner_id", "active_job", "decision")


@query("select arg_min(bytes, id) as bytes, digest from assets group by digest", ("assets",))
def agg6_unique_bytes(a: Archive):
    return a.assets.groupBy("digest").agg(F.min_by("bytes", "id").alias("bytes"))


@query("select digest, min(id) as id, arg_min(bytes, id) as bytes, '_objects/sha256/' || left(digest, 2) || '/' || digest as path from assets group by digest", ("assets",))
def snk6_stored_objects(a: Archive):
    return objects.stored_objects(a.assets)


@query(
    """select state, count(*) as n, sum(bytes)::bigint as bytes from (select digest, arg_min(bytes, id) as bytes, case when bool_or(id in (select doc_id from labels)) then 'protected'
    when min(id) % 5 = 0 then 'shared' else 'reclaimable' end as state from assets group by digest) group by state""",
    ("assets",),
)
def ded2_garbage_report(a: Archive):
    stored = objects.stored_objects(a.assets)
    used = a.assets.join(a.raw("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    links = stored.select("digest", F.when(F.col("id") % 5 == 0, 2).otherwise(1).alias("links"))
    return objects.garbage(stored, [used], links).groupBy("state").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(
    """select state, count(*) as n from (select digest, case when bool_or(id in (select doc_id from labels) or id % 7 = 0) then 'protected' else 'reclaimable' end as state from assets group by digest) group by state""",
    ("assets",),
)
def ded3_garbage_with_manifests(a: Archive):
    stored = objects.stored_objects(a.assets)
    used = a.assets.join(a.raw("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return objects.garbage(stored, [used, a.assets.where("id % 7 = 0")]).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """select state, count(*) as n from (select case when a.doc_id is null then 'unlisted' when e.doc_id is null then 'missing' when a.b <> e.b then 'size' when a.d <> e.d then 'digest' else 'ok' end as state
    from (select doc_id, strlen(text) + if(doc_id % 50 = 1, 1, 0) as b, if(doc_id % 50 = 2, 'x', sha256(text)) as d from documents where doc_id % 10 <> 3) e
    full join (select doc_id, strlen(text) as b, sha256(text) as d from documents where doc_id % 10 <> 4) a on a.doc_id = e.doc_id) group by state"""
)
def int2_inventory_diff(a: Archive):
    path = F.concat(F.lit("assets/"), F.col("id").cast("string")).alias("path")
    actual = a.assets.where("id % 10 <> 3").select(path, (F.col("bytes") + F.when(F.col("id") % 50 == 1, 1).otherwise(0)).alias("bytes"), F.when(F.col("id") % 50 == 2, "x").otherwise(F.col("digest")).alias("digest"))
    expected = a.assets.where("id % 10 <> 4").select(path, "bytes", "digest")
    return objects.inventory_diff(actual, expected).groupBy("state").agg(F.count("*").alias("n"))


@query("select doc_id as id from documents anti join labels using (doc_id)")
def jn18_orphans(a: Archive):
    return a.assets.join(a.raw("labels").select(F.col("doc_id").alias("id")), "id", "left_anti").select("id")


@query("select count(*) as unresolved from (select distinct snapshot_id from assets) t where snapshot_id not in (select id from snapshots)", ("assets", "snapshots"))
def jn19_containment(a: Archive):
    refs = a.assets.select("snapshot_id").distinct()
    return objects.referential_audit(a.snapshots, "id", refs, "snapshot_id").agg(F.count("*").alias("unresolved"))


@query("select id, path like '/%' or list_contains(string_split(path, '/'), '..') or path = '' as unsafe from (select page_id as id, regexp_replace(url, '^https?://[^/]*', if(page_id % 3 = 0, '..', '')) as path from pages)")
def flt17_unsafe_paths(a: Archive):
    path = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://[^/]*", "..")).otherwise(F.regexp_replace("url", "^https?://[^/]*", ""))
    return a.raw("pages").select(F.col("page_id").alias("id"), objects.unsafe_path(path).alias("unsafe"))


_WIRE = "'sha256:' || rtrim(replace(replace(base64(unhex(digest)), '+', '-'), '/', '_'), '=')"


@query(
    f"""select run_id, n_pages::int as n_pages, coalesce(n_resources, 0)::int as n_resources, true as valid, sha256('{{"pages":[' || p || '],"resources":[' || coalesce(r, '') || '],"run_id":"' || run_id || '"}}') as payload_sha256
    from (select run_id, count(*) as n_pages, string_agg('{{"id":' || id || ',"url":"' || source_url || '","digest":"' || {_WIRE} || '","bytes":' || bytes || '}}', ',' order by id) as p from snapshots group by run_id)
    left join (select run_id, count(*) as n_resources, string_agg('{{"id":' || t.id || ',"digest":"' || {_WIRE.replace('(digest', '(t.digest')} || '","bytes":' || t.bytes || '}}', ',' order by t.id) as r
      from assets t join snapshots s on s.id = t.snapshot_id group by run_id) using (run_id)""",
    ("snapshots", "assets"),
)
def int5_manifests(a: Archive):
    rows = objects.manifests(a.snapshots, a.assets)
    return rows.select("run_id", F.size("pages").alias("n_pages"), F.size("resources").alias("n_resources"), objects.valid_manifest(F.col("pages"), F.col("resources")).alias("valid"), F.sha2("payload", 256).alias("payload_sha256"))


@query("select s.run_id, count(distinct s.id) as n_pages, count(a.id) as n_resources, true as valid from snapshots s left join assets a on a.snapshot_id = s.id group by s.run_id", ("snapshots", "assets"))
def int3_valid_manifests(a: Archive):
    rows = objects.manifests(a.snapshots, a.assets)
    return rows.select("run_id", F.size("pages").cast("long").alias("n_pages"), F.size("resources").cast("long").alias("n_resources"), objects.valid_manifest(F.col("pages"), F.col("resources")).alias("valid"))


@query("select snapshot_id, (id % 5)::bigint as id, count(*) as n from assets group by all having count(*) > 1", ("assets",))
def agg24_duplicate_ids(a: Archive):
    return objects.duplicate_ids(a.assets.select("snapshot_id", (F.col("id") % 5).alias("id")))


@query("select id, status, captured + if(id % 10 = 0, 100, 0) as captured from jobs where id % 9 <> 0 or id % 10 = 0", ("jobs",))
def snk2_upsert(a: Archive):
    rows = a.jobs.select("id", "status", "captured")
    new = rows.where("id % 10 = 0").withColumn("captured", F.col("captured") + 100)
    return dml.upsert(rows.where("id % 9 <> 0"), new, ["id"])


@query("select url, min(id) as id from attempts where url not in (select url from attempts where status = 'failed' and job_id < 20) group by url", ("attempts",))
def snk3_insert_ignore(a: Archive):
    return dml.insert_ignore(a.attempts.where("status = 'failed' and job_id < 20").select("url"), a.attempts.select("url", "id"), ["url"], "id")


@query("select action, count(*) as n from (select case when id % 10 = 0 then 'insert' when id % 9 = 0 then 'delete' when id % 7 = 0 then 'update' end as action from jobs) where action is not null group by action", ("jobs",))
def snk1_document_diff(a: Archive):
    rows = a.jobs.select("id", "status", "captured")
    old, new = rows.where("id % 10 <> 0"), rows.where("id % 9 <> 0 or id % 10 = 0").withColumn("captured", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("captured")))
    return dml.diff(old, new, "id").groupBy("action").agg(F.count("*").alias("n"))


@query("select run_id, min(id) as entry_id, count(*) as pages from snapshots where id % 3 <> 0 group by run_id", ("snapshots",))
def snk16_after_delete(a: Archive):
    return dml.after_delete(a.snapshots, a.snapshots.where("id % 3 = 0"))


@query("select (id // 2)::bigint as id, 'repeated' as problem from jobs group by all having count(*) > 1", ("jobs",))
def msc2_invalid_records(a: Archive):
    return dml.invalid_records(a.jobs.select(F.expr("id div 2").alias("id")), "id")


@query("select s.id, count(a.id) as n_assets, min(a.id) as first_asset, coalesce(sum(a.bytes), 0)::bigint as bytes from snapshots s left join assets a on a.snapshot_id = s.id group by s.id", ("snapshots", "assets"))
def jn14_nested_assets(a: Archive):
    rows = dml.nested(a.snapshots.select("id"), a.assets.select("snapshot_id", "id", "bytes"), "snapshot_id", "assets")
    return rows.select("id", F.size("assets").cast("long").alias("n_assets"), F.try_element_at("assets", F.lit(1))["id"].alias("first_asset"), F.aggregate("assets", F.lit(0).cast("long"), lambda z, x: z + x["bytes"]).alias("bytes"))


@query("select t.id from attempts t where t.job_id in (select id from jobs where id % 6 <> 0)", ("attempts", "jobs"))
def snk1_cascade(a: Archive):
    return dml.cascade(a.jobs.where("id % 6 <> 0"), a.attempts.select("id", "job_id"), "job_id").select("id")


def _put(name: str, rest: str) -> None:
    SQL[name] = "with " + ", ".join(f"{v} as ({VIEWS_SQL[v]})" for v in _V) + ", " + _USAGE + rest


_put("agg11_owner_usage", " select owner_id, used from rep")
_put("agg12_reservations", " select owner_id, reserved from res")
_put(
    "agg13_quota_report",
    """ select owner_id, name, quota, used, reserved, used + reserved as committed, greatest(0, quota - used - reserved) * if(quota is null, null, 1) as available,
    round((used + reserved) * 100.0::double / quota, 6) as percent_committed, coalesce((used + reserved) * 100.0::double / quota >= 80, false) as warning, coalesce(used > quota, false) as over from rep""",
)
_put("agg14_capacity", " select sum(used)::bigint as used, sum(reserved)::bigint as reserved, greatest(0, 10000000000 - sum(used) - sum(reserved))::bigint as available, sum(used) > 10000000000 as over from rep")
_put("agg15_quota_summaries", " select owner_id, name, quota, used from rep where quota is not null")
_put(
    "job1_admission",
    """ select s.id as site_id, s.owner_id, act.j as active_job, case when act.j is not null then 'site_active' when s.id * 1000000000 > if(rep.quota is null, null, greatest(0, rep.quota - used - reserved)) then 'quota' else 'admit' end as decision
    from sites s left join (select site_id, min(id) as j from jobs where status = 'running' group by site_id) act on act.site_id = s.id left join rep on rep.owner_id = s.owner_id""",
)


@query("select id, case when id % 4 = 0 then 'digest mismatch' when id % 4 = 1 then 'path' end as problem from assets", ("assets",))
def src4_object_store(a: Archive):
    from ..sources.files import object_store

    k = F.col("id") % 4
    path = F.concat(F.substring("digest", 1, 2), F.when(k == 1, F.lit("/x/")).otherwise(F.lit("/")), F.col("digest"))
    found = F.when(k == 0, F.concat(F.lit("0"), F.substring("digest", 2, 63))).otherwise(F.col("digest"))
    rows = a.assets.select("id", path.alias("path"), "bytes", F.when(k == 0, F.lit("none")).otherwise(found).alias("digest"))
    return object_store(rows).select("id", "problem")


@query()
def snk10_warc_records(a: Archive):
    from ..sources.packages import warc_records

    date = F.lit("2024-01-01T00:00:00Z")
    pages = a.snapshots.select(F.col("id").alias("seq"), F.col("final_url").alias("url"), date.alias("date"), F.lit(200).alias("status"), "content_type", "body")
    assets = a.assets.select((F.col("id") + 1_000_000_000).alias("seq"), F.concat(F.lit("https://site.test/a"), (F.col("id") % 100).cast("string")).alias("url"), date.alias("date"), F.lit(200).alias("status"), "content_type", "body")
    return warc_records(pages, assets).select("seq", F.length("record").alias("n_bytes"), F.sha2("record", 256).alias("sha256"))


@query("""select '{"action":"' || event_type || '","id":' || event_id || '}' as value from events""")
def snk15_log_lines(a: Archive):
    from ..sources.files import log_lines

    return log_lines(a.activity.select("id", "action"))


@query("select page_id as old_id, 'snap_' || left(sha256('x' || page_id), 20) as id, 'private' as visibility, '/snapshots/snap_' || left(sha256('x' || page_id), 20) || '/asset/a1' as body from pages")
def snk13_imported(a: Archive):
    from ..sources.packages import imported

    rows = a.raw("pages").select(F.col("page_id").alias("id"), F.concat(F.lit("/snapshots/"), F.col("page_id").cast("string"), F.lit("/asset/a1")).alias("body"))
    return imported(rows, "x").select("old_id", "id", "visibility", "body")
