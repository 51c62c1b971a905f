"""The archive's tables as views over the driver's tables; a table is scanned only for the columns that a query uses.

Which column stands for what is a choice of this library. ``VIEWS_SQL`` says the same for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: View name -> DuckDB SQL.
VIEWS_SQL = {
    "users": "select n_nationkey::bigint as id, n_name as name, lower(n_name) || '@example.test' as email, if(n_regionkey < 4, (n_regionkey + 1)::bigint * 100000000000, null) as quota from nation",
    "sites": "select c_custkey as id, c_nationkey::bigint as owner_id, c_name as name, 'https://www.' || lower(replace(c_name, '#', '-')) || '.test/' as url, if(c_mktsegment in ('BUILDING', 'MACHINERY'), 'private', 'public') as visibility, (array['daily','weekly','monthly','yearly'])[(c_custkey % 4 + 1)::int] as interval, if(c_custkey % 5 = 0, null, timestamp '2024-01-01' + to_days((c_custkey % 400)::int)) as next_at, c_custkey % 9 = 0 as paused from customer",
    "jobs": "select o_orderkey as id, o_custkey as site_id, (o_orderkey % 30)::bigint as actor_id, case when o_orderkey % 11 = 0 then 'interrupted' when o_orderstatus = 'F' then 'complete' when o_orderstatus = 'O' then 'error' else 'running' end as status, case substr(o_orderpriority, 1, 1) when '1' then 'retry' when '2' then 'scheduled' else 'live' end as kind, 'run_' || (o_orderkey // 3) as run_id, o_orderdate as created_at, case when o_orderstatus = 'P' then null else o_orderdate + to_seconds((o_orderkey % 5000)::int) end as finished_at, (o_orderkey % 4)::bigint as failed, (o_orderkey % 7)::bigint as captured, cast(floor(o_totalprice) as bigint) as reserved, if(o_orderstatus = 'O', 'HTTP 50' || (o_orderkey % 5) || ' 100% missing', null) as error, if(o_orderkey % 8 = 1, o_orderkey - 1, null) as retry_of, o_orderkey % 13 = 0 as auto_resume from orders",
    "attempts": "select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as id, l_orderkey as job_id, 'https://site.test/p' || (l_partkey % 50) as url, case l_returnflag when 'R' then 'failed' when 'A' then 'captured' else 'skipped' end as status, l_suppkey as snapshot_id, (l_linenumber % 4)::bigint as depth, cast(l_quantity as bigint) as bytes, l_shipdate as started_at from lineitem",
    "snapshots": "select page_id as id, page_id % 100 + 1 as site_id, 'run_' || (page_id // 25) as run_id, url as source_url, url as final_url, if(page_id % 17 = 0, 'wayback', 'live') as kind, if(page_id % 10 = 0, 'application/json', 'text/html; charset=utf-8') as content_type, strlen(html)::bigint as bytes, sha256(html) as digest, timestamp '2024-01-01' + to_hours(page_id::int) as created_at, html as body from pages",
    "assets": "select doc_id as id, doc_id // 7 * 2 as snapshot_id, source as folder, if(doc_id % 3 = 0, 'text/css', if(doc_id % 3 = 1, 'image/png', 'application/javascript')) as content_type, strlen(text)::bigint as bytes, sha256(text) as digest, text as body from documents",
    "activity": "select event_id as id, user_id as actor_id, event_type as action, props as detail, ts as created_at, value from events",
}


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front."""
    return "with " + ", ".join(f"{n} as ({VIEWS_SQL[n]})" for n in names) + "\n" + sql


class Archive:
    """The tables of one folder; each is read when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        quota = F.when(F.col("n_regionkey") < 4, (F.col("n_regionkey") + 1).cast("long") * 100_000_000_000)
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit("@example.test")).alias("email"), quota.alias("quota"))

    @cached_property
    def sites(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("id"), F.col("c_nationkey").cast("long").alias("owner_id"), F.col("c_name").alias("name"),
            F.concat(F.lit("https://www."), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".test/")).alias("url"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "private").otherwise("public").alias("visibility"),
            F.element_at(F.array(*map(F.lit, ("daily", "weekly", "monthly", "yearly"))), (k % 4 + 1).cast("int")).alias("interval"),
            F.when(k % 5 == 0, None).otherwise(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 400).cast("int"))).alias("next_at"),
            (k % 9 == 0).alias("paused"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        k, s = F.col("o_orderkey"), F.col("o_orderstatus")
        first = F.substring("o_orderpriority", 1, 1)
        return self.raw("orders").select(
            k.alias("id"), F.col("o_custkey").alias("site_id"), (k % 30).alias("actor_id"),
            F.when(k % 11 == 0, "interrupted").when(s == "F", "complete").when(s == "O", "error").otherwise("running").alias("status"),
            F.when(first == "1", "retry").when(first == "2", "scheduled").otherwise("live").alias("kind"),
            F.concat(F.lit("run_"), F.expr("o_orderkey div 3").cast("string")).alias("run_id"), F.col("o_orderdate").alias("created_at"),
            F.when(s == "P", None).otherwise(F.col("o_orderdate") + F.make_dt_interval(secs=(k % 5000).cast("decimal(18,6)"))).alias("finished_at"),
            (k % 4).alias("failed"), (k % 7).alias("captured"), F.floor("o_totalprice").cast("long").alias("reserved"),
            F.when(s == "O", F.concat(F.lit("HTTP 50"), (k % 5).cast("string"), F.lit(" 100% missing"))).alias("error"),
            F.when(k % 8 == 1, k - 1).alias("retry_of"), (k % 13 == 0).alias("auto_resume"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.raw("lineitem").select(
            (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("job_id"),
            F.concat(F.lit("https://site.test/p"), (F.col("l_partkey") % 50).cast("string")).alias("url"),
            F.when(flag == "R", "failed").when(flag == "A", "captured").otherwise("skipped").alias("status"), F.col("l_suppkey").alias("snapshot_id"),
            (F.col("l_linenumber") % 4).cast("long").alias("depth"), F.col("l_quantity").cast("long").alias("bytes"), F.col("l_shipdate").alias("started_at"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        k = F.col("page_id")
        return self.raw("pages").select(
            k.alias("id"), (k % 100 + 1).alias("site_id"), F.concat(F.lit("run_"), F.expr("page_id div 25").cast("string")).alias("run_id"), F.col("url").alias("source_url"), F.col("url").alias("final_url"),
            F.when(k % 17 == 0, "wayback").otherwise("live").alias("kind"), F.when(k % 10 == 0, "application/json").otherwise("text/html; charset=utf-8").alias("content_type"),
            F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=k.cast("int"))).alias("created_at"), F.col("html").alias("body"),
        )

    @cached_property
    def assets(self) -> DataFrame:
        k = F.col("doc_id")
        return self.raw("documents").select(
            k.alias("id"), F.expr("doc_id div 7 * 2").alias("snapshot_id"), F.col("source").alias("folder"),
            F.when(k % 3 == 0, "text/css").when(k % 3 == 1, "image/png").otherwise("application/javascript").alias("content_type"),
            F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"), F.col("text").alias("body"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("action"), F.col("props").alias("detail"), F.col("ts").alias("created_at"), "value")
