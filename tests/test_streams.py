"""Streams that end and resume give what one pass over all rows gives."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import shared
from quarrystone.streaming import activity, runs


@pytest.fixture
def events(spark):
    rows = spark.range(600).select("id", (F.col("id") * 7919 % 7).alias("who"), (F.col("id") * 3 + F.col("id") % 2 * 40).alias("s"))
    return rows.select("id", "who", F.timestamp_seconds("s").alias("created_at"))


def test_limiter_over_several_runs(spark, events, monkeypatch):
    folders = []
    monkeypatch.setattr(runs, "fresh_folder", lambda s, label: folders.append(shared.fresh_folder(s, label)) or folders[-1])
    cut = F.unix_seconds("created_at")
    parts = [events.where(cut < 500), events.where((cut >= 500) & (cut < 600)), events.where("false"), events.where(cut >= 600)]
    got = runs.resumed(parts, lambda s: activity.limited_stream(s, "who", 4, 60), "who", files=4, at_once=1)
    want = activity.limited(events, "who", 4, 60).select(F.col("who").cast("string"), "id", "allowed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(folders) == 1
    assert len(glob.glob(folders[0].removeprefix("file:") + "/checkpoint/commits/[0-9]*")) > len(parts)  # micro-batches


def test_a_run_that_is_broken_off_resumes(spark, events, tmp_path):
    cut = F.unix_seconds("created_at")
    for lo in range(0, 2000, 250):
        events.where((cut >= lo) & (cut < lo + 250)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        time.sleep(0.05)
    stream = lambda: activity.limited_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source"), "who", 4, 60)
    sink = lambda: stream().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks")
    with runs._state_store(spark):
        q = sink().trigger(processingTime="0 seconds").start(f"{tmp_path}/sink")
        deadline = time.time() + 100
        while time.time() < deadline and (q.lastProgress is None or q.lastProgress["batchId"] < 1):
            time.sleep(0.05)
        q.stop()
        some = spark.read.parquet(f"{tmp_path}/sink").count()
        sink().trigger(availableNow=True).start(f"{tmp_path}/sink").awaitTermination(100)
    want = activity.limited(events, "who", 4, 60).select(F.col("who").cast("string"), "id", "allowed")
    assert 0 < some and sorted(map(tuple, spark.read.parquet(f"{tmp_path}/sink").collect())) == sorted(map(tuple, want.collect()))


def test_frontier_over_runs_keeps_its_cap(spark):
    rows = spark.createDataFrame([("a", 1, "u1"), ("a", 2, "u2"), ("a", 3, "u1"), ("b", 4, "u9"), ("a", 5, "u3"), ("a", 6, "u4"), ("b", 7, "u9")], "job_id string, seq long, url string")
    got = runs.resumed([rows.where("seq < 3"), rows.where("seq between 3 and 4"), rows.where("seq > 4")], lambda s: activity.frontier_stream(s, 3), "job_id")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "u1"), ("a", 2, "u2"), ("a", 3, "u3"), ("b", 1, "u9")]


def test_order_holds_across_a_key_s_arrow_batches(spark):
    seq = F.col("id") * 7919 % 30_000
    rows = spark.range(30_000).select(F.lit("a").alias("job_id"), seq.alias("seq"), F.concat(F.lit("u"), (seq / 2).cast("int").cast("string")).alias("url")).repartition(3)
    got = runs.resumed([rows.where("seq < 25000"), rows.where("seq >= 25000")], lambda s: activity.frontier_stream(s, 5), "job_id", files=1)
    assert sorted(map(tuple, got.collect())) == [("a", i + 1, f"u{i}") for i in range(5)]
    events = rows.select(F.lit(1).alias("who"), F.col("seq").alias("id"), F.timestamp_seconds("seq").alias("created_at"))
    limited = runs.resumed([events], lambda s: activity.limited_stream(s, "who", 4, 60), "who", files=1)
    assert sorted(map(tuple, limited.collect())) == sorted(("1", i, i % 60 < 4) for i in range(30_000))
