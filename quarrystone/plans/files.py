"""Queries that write files to the shared folder and read them back: packages, backups, documents, stores, manifests, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import dml, objects, upkeep
from ..sources import files, packages
from ..sources.shared import fresh_folder
from ..sources.tables import Archive
from .registry import query

_PRODUCT = "own"


def _packages(a: Archive, kind: str, key):
    """The members of packages, one for each value of ``key``, once they have been written."""
    folder = fresh_folder(a.spark, f"{kind}s")
    pages = a.snapshots.select(key.alias("package"), "id", "source_url", "content_type", "body")
    assets = a.assets.select("snapshot_id", "id", "digest", "body")
    packages.write_packages(folder, _PRODUCT, kind, pages, assets).write.parquet(f"{folder}/_made")
    return packages.read_packages(a.spark, f"{folder}/*.tar.gz").withColumn("package", F.regexp_extract("package", r"([^/]+)\.tar\.gz$", 1))


_MEMBERS = """(select KEY as package, 'payload/pages/' || id as path, bytes, digest from snapshots union all
    select distinct KEY, 'payload/assets/' || t.digest, t.bytes, t.digest from assets t join snapshots s on s.id = t.snapshot_id)"""


@query(f"select * from {_MEMBERS.replace('KEY', 'run_id')}", ("snapshots", "assets"))
def src6_capture_members(a: Archive):
    members = _packages(a, "capture", F.col("run_id"))
    return members.where("path like 'payload/%'").select("package", "path", "bytes", "digest")


_SITE = "'site_' || site_id"


@query(f"select package, count(*) filter (path like 'payload/pages/%') as pages, count(*) filter (path like 'payload/assets/%') as assets, 0::bigint as problems from {_MEMBERS.replace('KEY', _SITE)} group by package", ("snapshots", "assets"))
def src7_site_packages(a: Archive):
    members = _packages(a, "site", F.concat(F.lit("site_"), F.col("site_id").cast("string")))
    bad = packages.verify(members).groupBy("package").agg(F.count("*").alias("problems"))
    return packages.summary(members).join(bad, "package", "left").select("package", "pages", "assets", F.coalesce("problems", F.lit(0)).cast("long").alias("problems"))


@query(
    f"""select package || ' ' || min(path) filter (path like 'payload/pages/%') as lost, 'reference ' || min(path) filter (path like 'payload/pages/%') as problem from {_MEMBERS.replace('KEY', 'run_id')} group by package
    union all select package || ' ' || min(path) filter (path like 'payload/pages/%'), 'missing ' || min(path) filter (path like 'payload/pages/%') from {_MEMBERS.replace('KEY', 'run_id')} group by package""",
    ("snapshots", "assets"),
)
def src8_damaged_backups(a: Archive):
    members = _packages(a, "backup", F.col("run_id"))
    first = members.where("path like 'payload/pages/%'").groupBy("package").agg(F.min("path").alias("path"))  # what each backup has lost
    found = packages.verify(members.join(first, ["package", "path"], "left_anti"))
    return found.select(F.concat_ws(" ", "package", F.substring_index("problem", " ", -1)).alias("lost"), "problem")


@query(f"select package, count(*)::int + 1 as files, count(*) filter (path like 'payload/pages/%')::int as pages, count(*) filter (path like 'payload/assets/%')::int as assets from {_MEMBERS.replace('KEY', 'run_id')} group by package", ("snapshots", "assets"))
def snk9_exported_captures(a: Archive):
    folder = fresh_folder(a.spark, "captures")
    pages = a.snapshots.select(F.col("run_id").alias("package"), "id", "source_url", "content_type", "body")
    return packages.write_packages(folder, _PRODUCT, "capture", pages, a.assets.select("snapshot_id", "id", "digest", "body")).select("package", "files", "pages", "assets")


@query(f"select package, count(*) filter (path like 'payload/pages/%') as pages, count(*) filter (path like 'payload/assets/%') as assets, sum(bytes)::bigint as payload_bytes from {_MEMBERS.replace('KEY', 'run_id')} group by package", ("snapshots", "assets"))
def msc9_capture_summaries(a: Archive):
    return packages.summary(_packages(a, "capture", F.col("run_id")).where("path like 'payload/%'")).withColumnRenamed("bytes", "payload_bytes")


def _documents(a: Archive):
    folder = fresh_folder(a.spark, "documents")
    files.documents(a.sites, a.snapshots, a.assets).write.text(folder)
    return files.read_document(a.spark, folder, lines=True)


@query("select s.id::varchar as id, s.site_id::varchar as site_id, s.source_url, s.bytes, row_number() over (partition by s.site_id order by s.id)::int - 1 as seq from snapshots s join sites on sites.id = s.site_id", ("snapshots", "sites"))
def src2_legacy_snapshots(a: Archive):
    return _documents(a)["snapshots"].select("id", "site_id", "source_url", "bytes", "seq")


@query("select t.snapshot_id::varchar as snapshot_id, t.id::varchar as id, t.bytes, t.digest as content_digest from assets t join snapshots s on s.id = t.snapshot_id join sites on sites.id = s.site_id", ("assets", "snapshots", "sites"))
def msc10_all_assets(a: Archive):
    return _documents(a)["assets"].select("snapshot_id", "id", "bytes", "content_digest")


def _store(a: Archive) -> str:
    """The folder of a content-addressed store of the pages' bodies."""
    folder = fresh_folder(a.spark, "store")
    files.put_objects(a.snapshots.select("digest", "body"), f"{folder}/sha256").write.parquet(f"{folder}/_put")
    return f"{folder}/sha256"


@query("select left(digest, 2) || '/' || digest as path, min(bytes) as bytes, null::varchar as problem from snapshots group by digest", ("snapshots",))
def src4_stored_bodies(a: Archive):
    return files.object_store(files.inventory(a.spark, _store(a), contents=True)).select("path", "bytes", "problem")


@query("select left(digest, 2) as prefix, count(distinct digest) as files, sum(bytes)::bigint as bytes from (select digest, min(bytes) as bytes from snapshots group by digest) group by prefix", ("snapshots",))
def src5_inventory(a: Archive):
    found = files.inventory(a.spark, _store(a))
    return found.groupBy(F.substring("path", 1, 2).alias("prefix")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("select id, if(kind = 'wayback', 0, least(bytes, 3000))::bigint as n from snapshots", ("snapshots",))
def src3_snapshot_bytes(a: Archive):
    path = F.concat(F.substring("digest", 1, 2), F.lit("/"), F.col("digest"))
    rows = a.snapshots.select("id", F.when(F.col("kind") == "wayback", F.concat(F.lit("../"), path)).otherwise(path).alias("file"))
    found = files.bodies(rows, files.inventory(a.spark, _store(a), contents=True), 3000)
    return found.select("id", F.octet_length("body").cast("long").alias("n"))


@query("select run_id, count(*)::int as pages, sum(bytes)::bigint as bytes, min(id)::varchar as first_id from snapshots group by run_id", ("snapshots",))
def src9_read_manifests(a: Archive):
    folder = fresh_folder(a.spark, "manifests")
    made = objects.manifests(a.snapshots, a.assets)
    made.select(F.concat(F.lit('{"payload":'), F.col("payload"), F.lit(',"signature":{"key":"none"}}')).alias("value")).write.text(folder)
    back = files.read_manifests(a.spark, folder, lines=True).select("payload.*")
    return back.select("run_id", F.size("pages").alias("pages"), F.aggregate("pages", F.lit(0).cast("long"), lambda z, p: z + p["bytes"]).alias("bytes"), F.col("pages")[0]["id"].alias("first_id"))


@query("select run_id, case when not starts_with(arg_min(source_url, id), 'https') then 'key' when count(*) < 25 then 'fields' end as problem from snapshots group by run_id", ("snapshots",))
def int4_envelopes(a: Archive):
    # each run is signed by the key that its first page's scheme names; runs that were cut short lack a field
    first = a.snapshots.groupBy("run_id").agg(F.substring_index(F.min_by("source_url", "id"), ":", 1).alias("key_id"), F.count("*").alias("n"))
    rows = objects.manifests(a.snapshots, a.assets).join(first, "run_id")
    start = F.concat(F.lit('{"algorithm":"Ed25519","key_id":"'), F.col("key_id"), F.lit('","payload":'), F.col("payload"), F.lit(',"schema":"own-1"'))
    json = F.concat(start, F.when((F.col("n") < 25) & (F.col("key_id") == "https"), F.lit("}")).otherwise(F.concat(F.lit(',"signature":"'), F.lit("A" * 86), F.lit('"}'))))
    return rows.select("run_id", objects.envelope_problem(json, "own-1", F.lit("https")).alias("problem"))


@query("select event_type as action, count(*) as n, min(event_id) as first_id from events group by action")
def snk14_appended_events(a: Archive):
    folder = fresh_folder(a.spark, "events")
    rows = a.activity.select("id", "action", "actor_id", "detail")
    for part in ("action = 'error'", "action <> 'error'"):
        rows.where(part).write.mode("append").json(folder)
    back = a.spark.read.schema("id long, action string, actor_id long, detail string").json(folder)
    return back.groupBy("action").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    """select id, site_id, actor_id, kind, status, captured, failed, created_at, finished_at, run_id as capture_run_id, retry_of as retry_of_job_id, reserved as quota_reserved_bytes, auto_resume as auto_resume_pending,
    captured + failed as max_pages, run_id as label from jobs""",
    ("jobs",),
)
def prj1_job_records(a: Archive):
    parameters = F.to_json(F.struct((F.col("captured") + F.col("failed")).alias("max_pages"), F.col("run_id").alias("label")))
    stored = a.jobs.select(
        "id", "site_id", "actor_id", "kind", "status", "captured", "failed", "created_at", "finished_at", F.col("run_id").alias("capture_run_id"), F.col("retry_of").alias("retry_of_job_id"),
        F.col("reserved").alias("quota_reserved_bytes"), F.col("auto_resume").cast("int").alias("auto_resume_pending"), parameters.alias("parameters_json"),
    )
    return upkeep.job_records(stored, "max_pages long, label string").select("*", "parameters.*").drop("parameters")


@query("select event_id as id, json_extract(props, '$.k')::bigint as k, event_type as outcome from events")
def prj2_run_records(a: Archive):
    runs = a.activity.select("id", F.col("action").alias("outcome"), F.col("detail").alias("extra_json"))
    return upkeep.run_records(runs).select("id", F.try_variant_get("extra", "$.k", "long").alias("k"), "outcome")


@query("select id, if(status = 'error', 'retired', status) as status, captured from jobs where site_id not in (select id from sites where paused)", ("jobs", "sites"))
def msc1_replaced_document(a: Archive):
    old = a.jobs.select("id", "status", "captured")
    left = a.jobs.join(a.sites.where("paused").select(F.col("id").alias("site_id")), "site_id", "left_anti")
    new = left.select("id", F.when(F.col("status") == "error", "retired").otherwise(F.col("status")).alias("status"), "captured")
    return dml.replaced(old, new, "id")


_HOST = "split_part(split_part(url, '://', 2), '/', 1)"
_FIELD = "(list_filter(string_split(split_part(regexp_replace(url, '#.*$', ''), '?', 2), '&'), lambda p: starts_with(p, '{0}=')))"


@query(f"select page_id, nullif(split_part({_FIELD.format('page')}[-1], '=', 2), '') as page, {_HOST} || ' & co' as ref, len(list_distinct(list_filter(list_transform(string_split(split_part(regexp_replace(url, '#.*$', ''), '?', 2), '&'), lambda p: split_part(p, '=', 1)), lambda p: p not in ('', 'ref')))) + 1 as n from pages")
def src14_form_fields(a: Archive):
    body = F.concat(urls.query(F.col("url")), F.lit("&empty=&ref="), urls.netloc(F.col("url")), F.lit("+%26+co"))
    fields = a.raw("pages").select("page_id", urls.form_fields(body).alias("f"))
    return fields.select("page_id", F.col("f")["page"].alias("page"), F.col("f")["ref"].alias("ref"), F.size(F.map_keys("f")).cast("long").alias("n"))


@query(
    """select doc_id, if(ok, name, null) as name, if(ok, substr(line, length(name) + 2), null) as value, if(ok, null, 'invalid entry') as problem from (
    select doc_id, line, split_part(line, '=', 1) as name, contains(line, '=') and regexp_full_match(split_part(line, '=', 1), '\\p{L}[\\p{L}\\p{N}_]*') as ok from (
    select doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), ' ', '='), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from documents) where line <> '' and not starts_with(line, '#'))"""
)
def src15_settings(a: Archive):
    lines = a.raw("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return files.settings(lines.withColumn("value", F.expr("regexp_replace(value, '^([^ ]*) ', '$1=')")))
