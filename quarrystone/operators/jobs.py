"""Jobs, attempts and activity: search, numbering, streaks, admission, recovery.

``seq`` columns are explicit: the id orders rows where the insertion order counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..sources.shared import checkpointed
from .joins import dealt

#: Bounds of page sizes and of the alert threshold.
PAGE_MOST, RECENT_MOST, ATTEMPTS_MOST, STREAK_LEAST, STREAK_MOST = 200, 500, 1000, 2, 20


def clamp(n: int, least: int, most: int) -> int:
    return max(least, min(most, n))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def top_per(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "_rank") -> DataFrame:
    """The first k rows of each key; a window-group limit runs before the shuffle."""
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k).drop(name)


def first_per(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The first row of each key as an aggregate, which combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return one.select(*keys, "_r.*").select(*rows.columns)


def attempt_counts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Jobs with ``n_attempts``, 0 where there are none."""
    n = attempts.groupBy("job_id").agg(F.count("*").alias("n_attempts"))
    return jobs.join(n, jobs["id"] == n["job_id"], "left").select(jobs["*"], F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"))


def search_jobs(jobs: DataFrame, sites: DataFrame, users: DataFrame, attempts: DataFrame, status: str | None = None, kind: str | None = None, site_id: int | None = None, text: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first, with site, actor, number of attempts and the total of all hits.

    Attempts are counted for the page's jobs only.
    """
    named = jobs.join(sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name")), "site_id").join(users.select(F.col("id").alias("actor_id"), F.col("email").alias("actor")), "actor_id", "left")
    hit = named.where(all_of(F.col("status") == status if status else None, F.col("kind") == kind if kind else None, F.col("site_id") == site_id if site_id else None, contains_any(text, F.col("site_name"), F.col("actor"), F.col("error")) if text.strip() else None))
    page = hit.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(clamp(limit, 1, PAGE_MOST))
    total = hit.agg(F.count("*").alias("total"))
    counted = attempt_counts(page, attempts.join(page.select(F.col("id").alias("job_id")), "job_id", "left_semi"))
    return counted.crossJoin(total)  # one row


def search_events(events: DataFrame, users: DataFrame, text: str = "", action: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of events, newest first, with the actor's name and the total of all hits."""
    named = events.join(users.select(F.col("id").alias("actor_id"), F.col("name").alias("actor")), "actor_id", "left")
    hit = named.where(all_of(F.col("action") == action if action else None, contains_any(text, F.col("action"), F.col("detail"), F.col("actor")) if text.strip() else None))
    page = hit.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(clamp(limit, 1, PAGE_MOST))
    return page.crossJoin(hit.agg(F.count("*").alias("total")))


def failure_streaks(jobs: DataFrame, threshold: int = 3) -> DataFrame:
    """Sites whose latest jobs all failed: site_id, failures, latest_id and alert_id, the job at which
    the streak first reached the threshold. Running jobs don't count; any other job without a failure ends it."""
    least = clamp(threshold, STREAK_LEAST, STREAK_MOST)
    bad = (F.col("status") == "error") | ((F.col("status") == "interrupted") & (F.col("failed") > 0))
    done = jobs.where("status <> 'running'").select("site_id", "id", "created_at", bad.alias("bad"))
    last_good = done.where(~F.col("bad")).groupBy("site_id").agg(F.max(F.struct("created_at", "id")).alias("good"))
    streak = done.where("bad").join(last_good, "site_id", "left").where(F.col("good").isNull() | (F.struct("created_at", "id") > F.col("good")))
    counts = streak.groupBy("site_id").agg(F.count("*").alias("failures"), F.max_by("id", F.struct("created_at", "id")).alias("latest_id"))
    # the rank is cut at the threshold before the shuffle, so a site with many jobs sends few
    ranked = streak.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("created_at", "id"))).where(F.col("n") <= least)
    alerts = ranked.where(F.col("n") == least).select("site_id", F.col("id").alias("alert_id"))
    return counts.where(F.col("failures") >= least).join(alerts, "site_id")


def numbered_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts with ``attempt_number`` for each job and address."""
    return attempts.withColumn("attempt_number", F.row_number().over(Window.partitionBy("job_id", "url").orderBy("id")))


def operations_summary(jobs: DataFrame, attempts: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: jobs by state, failed attempts, mean seconds of a job, logical and unique bytes."""
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(1_000_000)
    state = jobs.agg(*(F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in ("running", "complete", "error", "interrupted")), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_seconds"))
    failed = attempts.agg(F.count_if(F.col("status") == "failed").alias("failed_attempts"))
    unique = assets.groupBy(F.coalesce("digest", F.concat_ws(":", "snapshot_id", "id"))).agg(F.sum("bytes").alias("all"), F.min_by("bytes", "id").alias("one"))
    sizes = unique.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("one"), F.lit(0)).alias("unique_bytes"))
    return state.crossJoin(failed).crossJoin(sizes)  # single rows


def frontier_counts(attempts: DataFrame) -> DataFrame:
    """Outcome counts of each job and the number of attempts that are done."""
    return attempts.groupBy("job_id").agg(F.count("*").alias("done"), *(F.count_if(F.col("status") == s).alias(s) for s in ("captured", "failed", "skipped")))


def claim_resumable(jobs: DataFrame, slots: int) -> DataFrame:
    """The oldest jobs that wait to resume, as many as running jobs leave slots free."""
    running = jobs.where("status = 'running'").agg(F.count("*").alias("busy"))
    waiting = jobs.where("auto_resume and status = 'interrupted'").orderBy("created_at", "id").limit(max(0, slots))
    ranked = waiting.withColumn("rank", F.row_number().over(Window.orderBy("created_at", "id")))  # at most ``slots`` rows
    return ranked.crossJoin(running).where(F.col("rank") <= slots - F.col("busy")).drop("busy")


def interrupted(jobs: DataFrame) -> DataFrame:
    """What a restart makes of running jobs: interrupted and waiting to resume."""
    run = F.col("status") == "running"
    return jobs.withColumns({"status": F.when(run, "interrupted").otherwise(F.col("status")), "auto_resume": F.when(run, True).otherwise(F.col("auto_resume")), "finished_at": F.when(run, F.col("created_at")).otherwise(F.col("finished_at"))})


def interrupt_cascade(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Open attempts of interrupted jobs become failed."""
    stopped = jobs.where("status = 'interrupted'").select(F.col("id").alias("job_id")).withColumn("stopped", F.lit(True))
    joined = attempts.join(stopped, "job_id", "left")
    return joined.withColumn("status", F.when(F.col("stopped") & (F.col("status") == "skipped"), "failed").otherwise(F.col("status"))).drop("stopped")


def reseeded_frontier(jobs: DataFrame, attempts: DataFrame, max_pages: int) -> DataFrame:
    """The frontier that a restarted job gets: addresses tried before, in order, up to the cap."""
    mine = attempts.join(jobs.where("auto_resume").select(F.col("id").alias("job_id")), "job_id", "left_semi")
    firsts = mine.groupBy("job_id", "url").agg(F.min("id").alias("seq"), F.min("depth").alias("depth"), F.max(F.col("status") == "captured").alias("captured"))
    return top_per(firsts, ["job_id"], [F.col("seq")], max_pages).select("job_id", "url", "seq", "depth", F.when(F.col("captured"), "done").otherwise("pending").alias("state"))


def retry_seeds(jobs: DataFrame, attempts: DataFrame, most: int = 500) -> DataFrame:
    """Addresses that failed and were never captured, of jobs that retry another: job_id, url, depth 0."""
    retries = jobs.where("retry_of is not null").select("id", "retry_of")
    tried = attempts.join(retries, attempts["job_id"] == retries["retry_of"]).groupBy(retries["id"].alias("job_id"), "url")
    failed = tried.agg(F.min(attempts["id"]).alias("seq"), F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "captured").alias("good")).where("bad > 0 and good = 0")
    return top_per(failed, ["job_id"], [F.col("seq")], most).select("job_id", "url", F.lit(0).alias("depth"))


def retry_lineage(jobs: DataFrame, most: int = 16) -> DataFrame:
    """id, root, generation: each job's first ancestor by retries, at most ``most`` levels."""
    link = jobs.select("id", "retry_of")
    # jobs that lead no further are done; they would all share one null key
    done = [link.where("retry_of is null").select("id", F.col("id").alias("root"), F.lit(0).alias("generation"))]
    level = link.where("retry_of is not null").select("id", F.col("retry_of").alias("up"), F.lit(0).alias("generation"), F.col("id").alias("root"))
    for _ in range(most):
        up = dealt(link, "id").select(F.col("id").alias("root2"), F.col("retry_of").alias("next"))
        joined = level.join(up, level["up"] == up["root2"], "left")
        found = F.col("root2").isNotNull()
        level = checkpointed(joined.select("id", F.when(found, F.col("next")).alias("up"), (F.col("generation") + found.cast("int")).alias("generation"), F.coalesce("root2", "root").alias("root")))
        done.append(level.where("up is null").select("id", "root", "generation"))
        level = level.where("up is not null")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, level.select("id", "root", "generation")])


def latest_success(attempts: DataFrame) -> DataFrame:
    """The snapshot of the latest captured attempt of each job and address."""
    return attempts.where("status = 'captured'").groupBy("job_id", "url").agg(F.max_by("snapshot_id", "id").alias("snapshot_id"))


def claim_snapshots(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """The run that owns each snapshot: that of the earliest job with an attempt on it."""
    tried = attempts.where("status = 'captured'").select("job_id", "snapshot_id").distinct()
    both = tried.join(jobs.select(F.col("id").alias("job_id"), "created_at", "run_id"), "job_id")
    return both.groupBy("snapshot_id").agg(F.min_by("run_id", F.struct("created_at", "job_id")).alias("run_id"), F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def run_status(captured: Column, failed: Column) -> Column:
    return F.when((captured > 0) & (failed == 0), "complete").when(captured > 0, "partial").otherwise("error")


def terminal(status: Column, finished: Column, now: Column) -> Column:
    """The end stamp of an update: none while running, else the old one or now."""
    return F.when(status == "running", None).otherwise(F.coalesce(finished, now))
