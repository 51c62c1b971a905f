"""Queries on activity over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..sources.tables import Archive
from ..streaming import activity as S
from ..streaming import runs
from .registry import SQL, query


@query("")
def win8_rate_limiter(a: Archive):
    return S.limited(a.activity, "actor_id", 3, 86_400)


SQL["win8_rate_limiter"] = """with recursive e as (select user_id as actor_id, event_id as id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select actor_id, id, n, true as allowed, [t] as kept from e where n = 1
  union all select e.actor_id, e.id, e.n, len(list_filter(f.kept, lambda x: x > e.t - 86400000000)) < 3,
    if(len(list_filter(f.kept, lambda x: x > e.t - 86400000000)) < 3, list_append(list_filter(f.kept, lambda x: x > e.t - 86400000000), e.t), list_filter(f.kept, lambda x: x > e.t - 86400000000))
  from f join e on e.actor_id = f.actor_id and e.n = f.n + 1)
select actor_id, id, allowed from f"""


@query("select time_bucket(interval 1 hour, ts) as start, event_type as action, count(*) as n from events group by all")
def str_tumbling_counts(a: Archive):
    return S.tumbling(a.activity).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """select actor_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from (select *, sum(new) over (partition by actor_id order by ts, event_id) as s from (
    select user_id as actor_id, ts, event_id, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute then 1 else 0 end as new from events)) group by actor_id, s"""
)
def str_sessions(a: Archive):
    return S.sessions(a.activity).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("select event_id as id, count(*) over (partition by user_id order by epoch_us(ts) range between 900000000 preceding and current row) as n from events")
def str_sliding_counts(a: Archive):
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    return a.activity.select("id", F.count("*").over(Window.partitionBy("actor_id").orderBy(t).rangeBetween(-900_000_000, 0)).alias("n"))


@query("")
def str_limiter_resumed(a: Archive):
    events = a.activity.select("id", "actor_id", "created_at").withColumn("created_at", F.col("created_at").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(F.unix_micros("created_at"), [0.3, 0.6])).first()[0] or [0, 0]
    part = F.when(F.unix_micros("created_at") < cuts[0], 0).when(F.unix_micros("created_at") < cuts[1], 1).otherwise(2)
    found = runs.resumed([events.where(part == i) for i in range(3)], lambda s: S.limited_stream(s, "actor_id", 3, 86_400), "actor_id")
    return found.select(F.col("key").cast("long").alias("actor_id"), "id", "allowed")


SQL["str_limiter_resumed"] = SQL["win8_rate_limiter"]

_FOUND = """select lower(split_part(split_part(url, '://', 2), '/', 1)) as job, page_id * 1000 + generate_subscripts(l, 1) - 1 as seq, split_part(url, '://', 1) || '://' || lower(split_part(split_part(url, '://', 2), '/', 1)) || regexp_replace(unnest(l), '#.*$', '') as url
    from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages)"""


@query(f"select job, url, rank from (select job, url, row_number() over (partition by job order by min(seq)) as rank from ({_FOUND}) group by job, url) where rank <= 12")
def str_frontier_resumed(a: Archive):
    """Links as they are found page by page; a third of the pages arrives at a time."""
    pages = a.raw("pages").select("page_id", "url", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))
    target = urls.canonical_url(urls.resolve(F.col("url"), F.col("href")), "preserve")
    links = pages.select(F.lower(urls.netloc(F.col("url"))).alias("job_id"), (F.col("page_id") * 1000 + F.col("pos")).alias("seq"), target.alias("url"), "page_id")
    cuts = a.raw("pages").agg(F.percentile_approx("page_id", [0.3, 0.6])).first()[0] or [0, 0]
    part = F.when(F.col("page_id") < cuts[0], 0).when(F.col("page_id") < cuts[1], 1).otherwise(2)
    found = runs.resumed([links.where(part == i).drop("page_id") for i in range(3)], lambda s: S.frontier_stream(s, 12), "job_id")
    return found.select("job", "url", "rank")
