"""Queries on backups and on web-archive files: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import replay_link_key
from ..sources import backup, warc
from ..sources.shared import fresh_folder
from ..sources.stores import file_system
from ..sources.tables import Archive
from .registry import query


def _saved(a: Archive) -> dict[str, DataFrame]:
    bodies = a.snapshots.groupBy("digest").agg(F.first(F.col("body").cast("binary")).alias("body"))
    return {"sites": a.sites, "snapshots": a.snapshots.drop("body"), "activity": a.activity, "bodies": bodies}


@query(
    """select 'sites' as name, count(*) as n, sum(id)::bigint as total, null as problem from sites union all select 'snapshots', count(*), sum(id + bytes)::bigint, null from snapshots
    union all select 'activity', count(*), sum(id)::bigint, null from activity union all select 'bodies', count(distinct digest), (select sum(b)::bigint from (select any_value(bytes) as b from snapshots group by digest)), null from snapshots
    union all select 'altered', 0, count(*), 'size' from sites union all select 'unpublished', 0, count(*), 'incomplete' from sites""",
    ("sites", "snapshots", "activity"),
)
def snk12_restored(a: Archive):
    """Tables are backed up and restored elsewhere; one backup is altered and one never published, and neither restores anything."""
    spark, folder = a.spark, fresh_folder(a.spark, "backup")
    backup.create(spark, _saved(a), f"{folder}/whole")
    back = backup.restore(spark, f"{folder}/whole", f"{folder}/elsewhere")
    size = {"sites": F.col("id"), "snapshots": F.col("id") + F.col("bytes"), "activity": F.col("id"), "bodies": F.octet_length("body")}
    of = lambda name, t: t.agg(F.count("*").alias("n"), F.sum(size[name]).cast("long").alias("total")).select(F.lit(name).alias("name"), "n", "total", F.lit(None).cast("string").alias("problem"))
    out = of("sites", back["sites"])
    for name in ("snapshots", "activity", "bodies"):
        out = out.unionByName(of(name, back[name]))
    for name in ("altered", "unpublished"):
        marker = backup.create(spark, {"sites": a.sites}, f"{folder}/{name}")
        store, root = file_system(f"{folder}/{name}")
        if name == "altered":
            first = backup.inventory(spark, f"{folder}/{name}/{marker['generation']}").agg(F.min("path")).first()[0]
            with store.open_output_stream(f"{root}/{marker['generation']}/{first}") as f:
                f.write(b"other bytes")
        else:
            store.delete_file(f"{root}/{backup.MARKER}")
        try:
            backup.restore(spark, f"{folder}/{name}", f"{folder}/none-{name}")
            problem = None
        except backup.BackupError as e:
            problem = str(e).rpartition(" ")[2]
        restored = len(backup._entries(f"{folder}/none-{name}"))
        out = out.unionByName(a.sites.agg(F.count("*").alias("total")).select(F.lit(name).alias("name"), F.lit(restored).cast("long").alias("n"), "total", F.lit(problem).alias("problem")))
    return out


def _warc(a: Archive) -> tuple[DataFrame, str]:
    when = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pages = a.snapshots.select(F.col("id").alias("seq"), F.col("final_url").alias("url"), when.alias("date"), (F.lit(200) + F.col("id") % 2 * 204).alias("status"), "content_type", "body")
    assets = a.assets.select((F.col("id") + 1_000_000_000).alias("seq"), F.concat(F.lit("https://site.test/a"), (F.col("id") % 100).cast("string")).alias("url"), F.lit("2023-12-31T00:00:00Z").alias("date"), F.lit(200).alias("status"), "content_type", "body")
    folder = fresh_folder(a.spark, "warc")
    return warc.write(pages, assets, folder, {"software": "quarrystone"}, 6, 1 << 20), folder


_RECORDS = """rec as (select page_id as seq, url, strftime(timestamp '2024-01-01' + to_hours(page_id::int), '%Y-%m-%dT%H:%M:%SZ') as date, (200 + page_id % 2 * 204)::int as status, if(page_id % 10 = 0, 'application/json', 'text/html; charset=utf-8') as content_type, html as body from pages
    union all select min(doc_id) + 1000000000, 'https://site.test/a' || doc_id % 100, '2023-12-31T00:00:00Z', 200, arg_min(if(doc_id % 3 = 0, 'text/css', if(doc_id % 3 = 1, 'image/png', 'application/javascript')), doc_id), any_value(text) from documents group by doc_id % 100, sha256(text))"""


@query(f"with {_RECORDS} select seq, url, 'response' as kind, date, status, content_type, strlen(body)::bigint as bytes, sha256(body) as digest, null as problem from rec")
def snk10_warc_read_back(a: Archive):
    """Every record, read from its place in the files."""
    index, _ = _warc(a)
    found = warc.read_records(index)
    return found.select("seq", "url", "kind", "date", "status", "content_type", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("digest"), "problem")


@query(
    f"""with {_RECORDS}, k as (select *, regexp_replace(split_part(url, '#', 1), '^([a-z]+://[^/?]*)(\\?|$)', '\\1/\\2') as key from rec), w as (select distinct key, '2024-01-03T12:00:00Z' as asked from k)
    select k.key, coalesce(arg_max(seq, (date, seq)) filter (date <= asked), arg_min(seq, (date, seq))) as seq, sha256(coalesce(arg_max(body, (date, seq)) filter (date <= asked), arg_min(body, (date, seq)))) as digest from k join w on w.key = k.key group by k.key"""
)
def snk10_warc_at(a: Archive):
    """For each address what it held at one time: one record is read for each."""
    index, _ = _warc(a)
    every = a.snapshots.select(replay_link_key(F.col("final_url")).alias("key")).unionByName(a.assets.select(F.concat(F.lit("https://site.test/a"), (F.col("id") % 100).cast("string")).alias("key")))
    places = warc.captures_at(index, every.distinct().withColumn("at", F.lit("2024-01-03T12:00:00Z")))
    return warc.read_records(places).select("key", "seq", F.sha2("body", 256).alias("digest"))
