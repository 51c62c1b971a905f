"""Queries on jobs, attempts and activity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..sources.tables import Archive
from .registry import query


@query("select status, count(*) as n from jobs group by status", ("jobs",))
def agg2_jobs_by_status(a: Archive):
    return a.jobs.groupBy("status").agg(F.count("*").alias("n"))


@query("select count(*) as running from jobs where status = 'running'", ("jobs",))
def agg1_running_jobs(a: Archive):
    return a.jobs.where("status = 'running'").agg(F.count("*").alias("running"))


@query("select status, count(*) as n, count(distinct job_id) as n_jobs, sum(bytes)::bigint as bytes from attempts group by status", ("attempts",))
def agg3_attempts_by_status(a: Archive):
    return a.attempts.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("n_jobs"), F.sum("bytes").alias("bytes"))


@query("select j.id, (select count(*) from attempts t where t.job_id = j.id) as n_attempts from jobs j", ("jobs", "attempts"))
def jn4_attempt_counts(a: Archive):
    return J.attempt_counts(a.jobs, a.attempts).select("id", "n_attempts")


@query("select j.id, s.name as site, s.visibility from jobs j join sites s on s.id = j.site_id", ("jobs", "sites"))
def jn1_jobs_with_sites(a: Archive):
    return a.jobs.join(a.sites.select(F.col("id").alias("site_id"), F.col("name").alias("site"), "visibility"), "site_id").select("id", "site", "visibility")


@query("select j.id, u.email as actor from jobs j left join users u on u.id = j.actor_id", ("jobs", "users"))
def jn2_jobs_with_actors(a: Archive):
    return a.jobs.join(a.users.select(F.col("id").alias("actor_id"), F.col("email").alias("actor")), "actor_id", "left").select("id", "actor")


@query("select e.id, u.name as actor, e.action from activity e left join users u on u.id = e.actor_id", ("activity", "users"))
def jn3_events_with_users(a: Archive):
    return a.activity.join(a.users.select(F.col("id").alias("actor_id"), F.col("name").alias("actor")), "actor_id", "left").select("id", "actor", "action")


@query("select j.id, j.status from jobs j where exists (select 1 from attempts t where t.job_id = j.id and t.status = 'failed')", ("jobs", "attempts"))
def jn7_jobs_with_failed_attempts(a: Archive):
    return a.jobs.join(a.attempts.where("status = 'failed'").select(F.col("job_id").alias("id")), "id", "left_semi").select("id", "status")


@query(
    """select job_id, snapshot_id, attempt_depth, row_number() over (partition by job_id order by attempt_depth, id) as place
    from (select t.job_id, t.id, s.id as snapshot_id, coalesce(t.depth, 999) as attempt_depth from attempts t join snapshots s on s.id = t.snapshot_id)""",
    ("attempts", "snapshots"),
)
def jn8_attempt_snapshots_by_depth(a: Archive):
    both = a.attempts.join(a.snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id").withColumn("attempt_depth", F.coalesce("depth", F.lit(999)))
    return both.select("job_id", "snapshot_id", "attempt_depth", F.row_number().over(Window.partitionBy("job_id").orderBy("attempt_depth", "id")).alias("place"))


@query(
    """select j.id as job_id, s.id as snapshot_id from jobs j join snapshots s on s.run_id = j.run_id
    where s.source_url like '%/en/%' or s.final_url like '%#top'""",
    ("jobs", "snapshots"),
)
def jn9_jobs_snapshots_by_address(a: Archive):
    s = a.snapshots.where(F.col("source_url").contains("/en/") | F.col("final_url").endswith("#top")).select(F.col("id").alias("snapshot_id"), "run_id")
    return a.jobs.select(F.col("id").alias("job_id"), "run_id").join(s, "run_id").select("job_id", "snapshot_id")


@query("select run_id, min(id) as first_job, arg_min(status, (created_at, id)) as first_status from jobs group by run_id", ("jobs",))
def jn12_first_job_of_run(a: Archive):
    return a.jobs.groupBy("run_id").agg(F.min("id").alias("first_job"), F.min_by("status", F.struct("created_at", "id")).alias("first_status"))


_SEARCH = """, hit as (select j.*, s.name as site_name, u.email as actor from jobs j join sites s on s.id = j.site_id left join users u on u.id = j.actor_id
    where j.status = 'error' and (lower(s.name) like '%100\\% missing%' escape '\\' or lower(coalesce(u.email, '')) like '%100\\% missing%' escape '\\' or lower(coalesce(j.error, '')) like '%100\\% missing%' escape '\\'))
    select id, site_name, actor, error, (select count(*) from attempts t where t.job_id = hit.id) as n_attempts, (select count(*) from hit) as total
    from hit order by created_at desc, id desc limit 20 offset 5"""


@query("", ("jobs",))
def job8_search_jobs(a: Archive):
    found = J.search_jobs(a.jobs, a.sites, a.users, a.attempts, status="error", text=" 100% Missing ", limit=20, offset=5)
    return found.select("id", "site_name", "actor", "error", "n_attempts", "total")


@query("", ("activity",))
def job9_search_events(a: Archive):
    return J.search_events(a.activity, a.users, text="click", limit=200).select("id", "action", "actor", "total")


@query(
    """, done as (select site_id, id, created_at, status = 'error' or (status = 'interrupted' and failed > 0) as bad from jobs where status <> 'running'),
    good as (select site_id, max((created_at, id)) as g from done where not bad group by site_id),
    n as (select d.site_id, d.id, row_number() over (partition by d.site_id order by d.created_at, d.id) as n from done d left join good using (site_id)
          where bad and (g is null or (d.created_at, d.id) > g))
    select site_id, count(*) as failures, arg_max(id, n) as latest_id, max(id) filter (n = 3) as alert_id from n group by site_id having count(*) >= 3""".lstrip(", "),
    (),
)
def win1_failure_streaks(a: Archive):
    return J.failure_streaks(a.jobs, 3)


@query("select id, row_number() over (partition by job_id, url order by id) as attempt_number from attempts", ("attempts",))
def win3_attempt_numbers(a: Archive):
    return J.numbered_attempts(a.attempts).select("id", "attempt_number")


@query(
    """select site_id, id, status, place from (select site_id, id, status, row_number() over (partition by site_id order by created_at desc, id desc) as place from jobs) where place <= 5""",
    ("jobs",),
)
def srt2_latest_jobs_per_site(a: Archive):
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("created_at"), F.desc("id")))
    return a.jobs.select("site_id", "id", "status", place.alias("place")).where("place <= 5")


@query("select id, created_at, status from jobs order by created_at desc, id desc limit 500", ("jobs",))
def srt3_recent_jobs(a: Archive):
    return a.jobs.select("id", "created_at", "status").orderBy(F.desc("created_at"), F.desc("id")).limit(J.clamp(10_000, 1, J.RECENT_MOST))


@query("select id, action, created_at from activity order by created_at desc, id desc limit 50 offset 100", ("activity",))
def srt4_event_page(a: Archive):
    return a.activity.select("id", "action", "created_at").orderBy(F.desc("created_at"), F.desc("id")).offset(100).limit(50)


@query("select job_id, arg_min(url, id) as url, min(id) as id from attempts where status = 'skipped' group by job_id", ("attempts",))
def srt5_next_pending(a: Archive):
    return a.attempts.where("status = 'skipped'").groupBy("job_id").agg(F.min_by("url", "id").alias("url"), F.min("id").alias("id"))


@query("select distinct action from activity", ("activity",))
def agg7_distinct_actions(a: Archive):
    return a.activity.select("action").distinct()


@query("select job_id, url, min(id) as first_id, count(*) as n from attempts where status = 'failed' group by job_id, url", ("attempts",))
def agg8_failed_urls(a: Archive):
    return a.attempts.where("status = 'failed'").groupBy("job_id", "url").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@query(
    "select job_id, count(*) as done, count(*) filter (status = 'captured') as captured, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped from attempts group by job_id",
    ("attempts",),
)
def agg10_frontier_counts(a: Archive):
    return J.frontier_counts(a.attempts)


@query(
    """select count(*) filter (status = 'running') as jobs_running, count(*) filter (status = 'complete') as jobs_complete, count(*) filter (status = 'error') as jobs_error,
    count(*) filter (status = 'interrupted') as jobs_interrupted, (select count(*) filter (status = 'failed') from attempts) as failed_attempts,
    (select sum(bytes)::bigint from assets) as logical_bytes, (select sum(b)::bigint from (select arg_min(bytes, id) as b from assets group by digest)) as unique_bytes,
    round(avg((epoch_us(finished_at) - epoch_us(created_at)) / 1000000), 3) as mean_seconds from jobs""",
    ("jobs", "attempts", "assets"),
)
def job10_operations_summary(a: Archive):
    return J.operations_summary(a.jobs, a.attempts, a.assets).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query("select job_id, url, arg_max(snapshot_id, id) as snapshot_id from attempts where status = 'captured' group by job_id, url", ("attempts",))
def job7_latest_success(a: Archive):
    return J.latest_success(a.attempts)


@query(
    """, tried as (select job_id, url, min(id) as seq, min(depth) as depth, bool_or(status = 'captured') as captured from attempts where job_id in (select id from jobs where auto_resume) group by job_id, url)
    select job_id, url, seq, depth, if(captured, 'done', 'pending') as state from (select *, row_number() over (partition by job_id order by seq) as r from tried) where r <= 4""".lstrip(", "),
    (),
)
def job3_reseeded_frontier(a: Archive):
    return J.reseeded_frontier(a.jobs, a.attempts, 4)


@query(
    """select r.id as job_id, t.url, 0 as depth from jobs r join attempts t on t.job_id = r.retry_of where r.retry_of is not null group by r.id, t.url
    having count(*) filter (t.status = 'failed') > 0 and count(*) filter (t.status = 'captured') = 0""",
    ("jobs", "attempts"),
)
def job6_retry_seeds(a: Archive):
    return J.retry_seeds(a.jobs, a.attempts)


@query(
    """, up as (select id, retry_of as next, id as root, 0 as generation from jobs
      union all select up.id, j.retry_of, j.id, up.generation + 1 from up join jobs j on j.id = up.next)
    select id, arg_max(root, generation) as root, max(generation) as generation from up group by id""".lstrip(", "),
    (),
)
def job6_retry_lineage(a: Archive):
    return J.retry_lineage(a.jobs)


@query(
    """select id, case when status = 'running' then 'interrupted' else status end as status, case when status = 'running' then true else auto_resume end as auto_resume from jobs""", ("jobs",)
)
def job4_interrupted(a: Archive):
    return J.interrupted(a.jobs).select("id", "status", "auto_resume")


@query(
    """select t.id, if(j.status = 'interrupted' and t.status = 'skipped', 'failed', t.status) as status from attempts t left join jobs j on j.id = t.job_id""", ("attempts", "jobs")
)
def job4_interrupt_cascade(a: Archive):
    return J.interrupt_cascade(a.jobs, a.attempts).select("id", "status")


@query("select id, created_at, row_number() over (order by created_at, id) as rank from jobs where auto_resume and status = 'interrupted' qualify rank <= 10000000 - (select count(*) from jobs where status = 'running') and rank <= 10000000", ("jobs",))
def job2_claim_resumable(a: Archive):
    return J.claim_resumable(a.jobs, 10_000_000).select("id", "created_at", "rank")


@query(
    """select snapshot_id, arg_min(run_id, (created_at, job_id)) as run_id, arg_min(job_id, (created_at, job_id)) as job_id
    from (select distinct t.job_id, t.snapshot_id, j.created_at, j.run_id from attempts t join jobs j on j.id = t.job_id where t.status = 'captured') group by snapshot_id""",
    ("attempts", "jobs"),
)
def win7_claimed_snapshots(a: Archive):
    return J.claim_snapshots(a.jobs, a.attempts)


@query("select id, case when captured > 0 and failed = 0 then 'complete' when captured > 0 then 'partial' else 'error' end as run_status from jobs", ("jobs",))
def agg25_run_status(a: Archive):
    return a.jobs.select("id", J.run_status(F.col("captured"), F.col("failed")).alias("run_status"))


@query("select id, site_id, status, kind from jobs where status = 'error' and kind = 'live'", ("jobs",))
def flt4_jobs_by_status_and_kind(a: Archive):
    return a.jobs.where(J.all_of(F.col("status") == "error", F.col("kind") == "live")).select("id", "site_id", "status", "kind")


@query("select id, url, status from attempts where job_id = 1 order by id limit 1000", ("attempts",))
def flt6_attempts_of_job(a: Archive):
    return a.attempts.where("job_id = 1").select("id", "url", "status").orderBy("id").limit(J.clamp(5000, 1, J.ATTEMPTS_MOST))


@query("select id, status, if(status = 'running', null, coalesce(finished_at, timestamp '2030-01-01')) as finished_at from jobs", ("jobs",))
def snk5_terminal_stamps(a: Archive):
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    return a.jobs.select("id", "status", J.terminal(F.col("status"), F.col("finished_at"), now).alias("finished_at"))


@query("select kind, actor_id, count(*) as n, count(*) filter (status = 'error') as n_error from jobs group by kind, actor_id", ("jobs",))
def agg22_counts_by_kind_and_actor(a: Archive):
    return a.jobs.groupBy("kind", "actor_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("n_error"))


def _fix() -> None:
    """SQL texts that start with further common table expressions."""
    from ..sources.tables import VIEWS_SQL
    from .registry import SQL

    def put(name: str, views: tuple[str, ...], rest: str, recursive: bool = False) -> None:
        head = "with recursive " if recursive else "with "
        SQL[name] = head + ", ".join(f"{v} as ({VIEWS_SQL[v]})" for v in views) + ", " + rest

    put("job8_search_jobs", ("jobs", "sites", "users", "attempts"), _SEARCH.lstrip(", "))
    put(
        "job9_search_events", ("activity", "users"),
        """hit as (select e.*, u.name as actor from activity e left join users u on u.id = e.actor_id
        where contains(lower(e.action), 'click') or contains(lower(e.detail), 'click') or contains(lower(coalesce(u.name, '')), 'click'))
        select id, action, actor, (select count(*) from hit) as total from hit order by created_at desc, id desc limit 200""",
    )
    put("win1_failure_streaks", ("jobs",), SQL["win1_failure_streaks"])
    put("job3_reseeded_frontier", ("jobs", "attempts"), SQL["job3_reseeded_frontier"])
    put("job6_retry_lineage", ("jobs",), SQL["job6_retry_lineage"], recursive=True)


_fix()
