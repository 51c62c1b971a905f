import datetime
import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import compare, crawl, dml, jobs, objects, policy, quota, search, secrets
from quarrystone.sources import files, packages
from quarrystone.streaming import activity

EDGES = [("r", 0, "a"), ("r", 1, "b"), ("r", 2, "a"), ("a", 0, "c"), ("a", 1, "r"), ("b", 0, "c"), ("b", 1, "d"), ("c", 0, "e"), ("d", 0, "e"), ("e", 0, "r")]


@pytest.mark.parametrize(
    "depth, cap, failed, expected",
    [(3, 100, [], "r:0 a:1 b:1 c:2 d:2 e:3"), (1, 100, [], "r:0 a:1 b:1"), (3, 4, [], "r:0 a:1 b:1 c:2"), (3, 100, ["b"], "r:0 a:1 b:1 c:2 e:3"), (0, 100, [], "r:0")],
)
def test_crawl(spark, depth, cap, failed, expected):
    edges, starts = spark.createDataFrame(EDGES, "src string, pos int, dst string"), spark.createDataFrame([(1, 0, "r"), (2, 0, "nowhere"), (2, 1, "r")], "job int, pos int, url string")
    bad = spark.createDataFrame([(f,) for f in failed], "url string") if failed else None
    rows = crawl.crawl(edges, starts, depth, cap, bad).orderBy("rank").collect()
    assert " ".join(f"{r['url']}:{r['depth']}" for r in rows if r["job"] == 1) == expected
    other = [(r["url"], r["rank"]) for r in rows if r["job"] == 2]  # each job has its own queue and cap
    assert other[:2] == [("nowhere", 1), ("r", 2)] and [k for _, k in other] == list(range(1, len(other) + 1)) and len(other) <= cap


def test_seeds(spark):
    jobs = spark.createDataFrame([(1, 9, None, "https://www.a.test/"), (2, None, "HTTPS://a.test/start?q=1#x", "https://a.test/"), (3, None, None, "https://a.test"), (4, None, "https://b.test/", "https://a.test/"), (5, 8, None, "https://a.test/no/")], "job_id int, retried int, start_url string, site_url string")
    failed = spark.createDataFrame([(9, "https://a.test/late", 5), (9, "https://a.test/x.png", 1), (9, "https://a.test/one", 2), (9, "https://a.test/one", 3), (7, "https://a.test/other", 1)], "retried int, url string, pos int")
    got = sorted((r["job_id"], r["url"], r["problem"]) for r in crawl.seeds(jobs, failed, 2, "drop", [], ["/no/*"]).collect())
    none = "no starting address is permitted"
    assert got == [(1, "https://a.test/one", None), (2, "https://a.test/start", None), (3, "https://a.test/", None), (4, None, none), (5, None, none)]


def test_outbound_forms(spark):
    from quarrystone.functions import urls

    rows = spark.createDataFrame([(u,) for u in ("https://a.b/", "ftp://a.b/", "https:///x", "https://u@a.b/", "https://a.b:65536/", "https://a.b:x/", "http://[::1]:80/", "a.b")], "u string")
    assert [r[0] for r in rows.select(urls.outbound_problem(F.col("u"))).collect()] == [None, "scheme", "scheme", "credentials", "port", "port", None, "scheme"]


def test_merged_records(spark):
    from quarrystone.operators import upkeep

    rows = [(1, i, "ok" if i % 3 else "failed", i % 2 == 0) for i in range(300)] + [(2, 5, "ok", True)]
    got = {r["k"]: r for r in upkeep.merged_records(spark.createDataFrame(rows, "k int, id int, kind string, late boolean"), "k", "late", "kind", "id").collect()}
    assert got[1]["items"] == list(range(1, 240, 2)) and got[1]["cut"] == 180 and got[1]["counts"] == {"ok": 200, "failed": 100}
    assert got[2]["items"] == [5] and got[2]["cut"] == 0 and got[2]["counts"] == {"ok": 1}


def job_rows(spark, states):
    day = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, 1, s, f, day + datetime.timedelta(i)) for i, (s, f) in enumerate(states, 1)], "id int, site_id int, status string, failed int, created_at timestamp_ntz")


def test_failure_streaks(spark):
    three = [("error", 1)] * 3
    streak = lambda s: [tuple(r) for r in jobs.failure_streaks(job_rows(spark, s), 3).select("failures", "latest_id", "alert_id").collect()]
    assert streak(three) == [(3, 3, 3)] and streak([*three, ("error", 0)]) == [(4, 4, 3)]
    assert streak([*three, ("complete", 0)]) == [] and streak([*three, ("running", 0)]) == [(3, 3, 3)]
    assert streak([("interrupted", 0), *three]) == [(3, 4, 4)] and streak([*three, ("interrupted", 0)]) == []


def test_quota(spark):
    users = spark.createDataFrame([(1, "a", "a@x", 200), (2, "b", "b@x", None), (3, "c", "c@x", 0)], "id long, name string, email string, quota long")
    used = spark.createDataFrame([(1, 54), (3, 5)], "owner_id long, used long")
    reserved = spark.createDataFrame([(1, 100)], "owner_id long, reserved long")
    report = quota.quota_report(users, used, reserved)
    r = {x["owner_id"]: x for x in report.collect()}
    assert (r[1]["available"], r[1]["percent_committed"], r[1]["warning"], r[1]["over"]) == (46, 77.0, False, False)
    assert (r[2]["available"], r[2]["percent_used"], r[3]["percent_used"], r[3]["over"]) == (None, None, 100.0, True)
    running = spark.createDataFrame([(9, 10, "running")], "id long, site_id long, status string")
    requests = spark.createDataFrame([(10, 1, 1), (11, 1, 50), (12, 1, 46), (13, 2, 10**9)], "site_id long, owner_id long, required long")
    got = {x["site_id"]: x["decision"] for x in quota.admission(requests, running, report, 2).collect()}
    assert got == {10: "site_active", 11: "quota", 12: "admit", 13: "admit"}
    assert {x["decision"] for x in quota.admission(requests.where("site_id > 10"), running, report, 1).collect()} == {"capacity"}


def test_dedup_and_garbage(spark):
    rows = spark.createDataFrame([(1, "d1", 9), (2, "d1", 9), (3, "d2", 6)], "id long, digest string, bytes long")
    r = objects.dedup_report(rows).first()
    assert (r["references"], r["unique_objects"], r["duplicate_references"], r["saved_bytes"], r["missing"]) == (3, 2, 1, 9, 0)
    links = spark.createDataFrame([("d2", 2)], "digest string, links int")
    states = lambda *a: {x["digest"]: x["state"] for x in objects.garbage(objects.stored_objects(rows), *a).collect()}
    assert states([rows.where("id = 1")]) == {"d1": "protected", "d2": "reclaimable"} and states([rows.where("id = 1")], links)["d2"] == "shared"


def test_comparison(spark):
    left = spark.createDataFrame([(1, "https://A/", "x", 1), (2, "https://a/gone", "y", 1)], "id int, source_url string, digest string, bytes int").withColumn("run_id", F.lit("l"))
    right = spark.createDataFrame([(3, "https://a/", "old", 1), (4, "https://a/#f", "z", 1), (5, "https://a/added", None, 0)], "id int, source_url string, digest string, bytes int").withColumn("run_id", F.lit("r"))
    got = {x["key"]: x["change"] for x in compare.compare_runs(left.unionByName(right), "l", "r").collect()}
    assert got == {"https://a/": "changed", "https://a/gone": "removed", "https://a/added": "added"}


def test_search_visibility(spark):
    sites = spark.createDataFrame([(1, 7, "Private", "https://p/", "private"), (2, 8, "Open", "https://o/", "public")], "id long, owner_id long, name string, url string, visibility string")
    day = datetime.datetime(2026, 1, 1)
    pages = spark.createDataFrame([(1, 1, "https://p/a", "https://p/a", "text/html", day, "<p>hidden phrase</p>"), (2, 2, "https://o/b", "https://o/b", "image/png", day, "hidden phrase")], "id long, site_id long, source_url string, final_url string, content_type string, created_at timestamp_ntz, body string")
    assert search.search(sites, pages, None, "hidden phrase").count() == 0
    hit = search.search(sites, pages, 7, "Hidden Phrase").collect()
    assert [(h["kind"], h["id"], h["excerpt"]) for h in hit] == [("content", 1, "hidden phrase")]
    assert [h["kind"] for h in search.search(sites, pages, 7, "o").collect()] == ["site", "page"]
    assert search.search(sites, pages, 7, "", datetime.date(2026, 1, 1)).count() == 2


def test_limiter_and_streams(spark, tmp_path):
    base = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("k", i, base + datetime.timedelta(seconds=t)) for i, t in enumerate((0, 1, 2, 11))], "who string, id long, created_at timestamp_ntz")
    got = activity.limited(rows, "who", 2, 10).orderBy("id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, out in (("limited", activity.limited_stream(stream, "who", 2, 10)), ("frontier", activity.frontier_stream(stream.select(F.lit(1).alias("job_id"), F.col("id").alias("seq"), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("url")), 2))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r["allowed"] for r in spark.table("limited").orderBy("id").collect()] == [True, True, False, True]
    assert [(r["rank"], r["url"]) for r in spark.table("frontier").orderBy("rank").collect()] == [(1, "u0"), (2, "u1")]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (4, "d")], "id int, v string")
    assert sorted(map(tuple, dml.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert {tuple(r) for r in dml.diff(old, new, "id").collect()} == {(1, "delete"), (2, "update"), (3, "delete"), (4, "insert")}
    twice = spark.createDataFrame([(4, "x", 2), (4, "y", 1), (1, "z", 0)], "id int, v string, seq int")
    assert [tuple(r) for r in dml.insert_ignore(old, twice, ["id"], "seq").collect()] == [(4, "y", 1)]
    nested = dml.nested(old, spark.createDataFrame([(1, 9, 5)], "parent int, id int, n int"), "parent", "kids").orderBy("id").collect()
    assert [len(r["kids"]) for r in nested] == [1, 0, 0]


def test_policy(spark):
    r = spark.range(1).select(*(c.alias(n) for n, c in policy.normalized(F.lit(-5.0), F.lit(999.0), F.lit("x"), F.lit("y")).items())).first()
    assert tuple(r) == (1.0, 120.0, "respect", "normalize")
    assert spark.range(1).select(policy.size_ceiling(F.lit(2), F.lit(10), F.lit(3), F.lit(4)).alias("n")).first()["n"] == 44
    r = spark.createDataFrame([("aws AKIA" + "A" * 16,), ("token = \"" + "0a" * 20 + '"',), ("clean",)], "text string")
    assert [sum(x[c] for c in secrets.CLASSES) for x in secrets.classes(r, "text").collect()] == [1, 1, 0]
    assert spark.range(1).select(secrets.forbidden_path(F.lit("a/data/x")).alias("b")).first()["b"]


def test_packages(spark, tmp_path):
    pages = spark.createDataFrame([("p1", "https://a/", "<p>/snapshots/p1/x</p>"), ("p2", "https://a/2", "two")], "id string, source_url string, body string")
    assets = spark.createDataFrame([("p1", "a1", "css"), ("p2", "a1", "css")], "snapshot_id string, id string, body string").withColumn("digest", F.sha2("body", 256))
    path = str(tmp_path / "one.tar.gz")
    assert packages.write_package(path, "own", "capture", {"site": {"url": "https://a/"}}, pages, assets) == {"files": 4, "pages": 2, "assets": 1}
    members = packages.read_packages(spark, path)
    assert packages.verify(members).count() == 0
    assert tuple(packages.summary(members).select("pages", "assets").first()) == (2, 1)
    bad = members.withColumn("digest", F.when(F.col("path") == "payload/pages/p1", "x").otherwise(F.col("digest")))
    assert [r["problem"] for r in packages.verify(bad).collect()] == ["digest payload/pages/p1"]
    assert [r["problem"] for r in packages.verify(members.where("path <> 'payload/pages/p2'")).orderBy("problem").collect()] == ["missing payload/pages/p2", "reference payload/pages/p2"]
    new = packages.imported(pages, "s").orderBy("old_id").first()
    assert new["id"] in new["body"] and new["visibility"] == "private"


def test_warc(spark, tmp_path):
    kind = "seq long, url string, date string, status int, content_type string, body string"
    pages = spark.createDataFrame([(1, "https://a/", "2026-01-01T00:00:00Z", None, "text/html", "hi")], kind)
    assets = spark.createDataFrame([(2, "https://a/x", "2026-01-01T00:00:00Z", 200, None, "css"), (3, "https://a/x", "2026-01-01T00:00:00Z", 200, None, "css")], kind)
    path = str(tmp_path / "x.warc.gz")
    assert packages.write_warc(path, {"site": "https://a/"}, "2026-01-01T00:00:00Z", packages.warc_records(pages, assets)) == 3
    raw = gzip.open(path).read()
    assert raw.count(b"WARC/1.1\r\n") == 3 and raw.count(b"WARC-Type: response") == 2 and b"HTTP/1.1 200 Archived" in raw


def test_files(spark, tmp_path):
    doc = {"users": [{"id": "u", "email": "e"}], "sites": [], "snapshots": [{"id": "s", "site_id": "x", "bytes": 42, "rendered": True, "assets": [{"id": "a", "bytes": 12}]}], "events": [{"id": "e"}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    t = files.read_document(spark, str(tmp_path / "doc.json"))
    assert [t[k].count() for k in ("users", "sites", "snapshots", "events", "assets")] == [1, 0, 1, 1, 1] and t["assets"].first()["bytes"] == 12
    import hashlib

    body, root = b"x", tmp_path / "sha256"
    name = hashlib.sha256(body).hexdigest()
    (root / name[:2]).mkdir(parents=True)
    (root / name[:2] / name).write_bytes(body)
    (root / name[:2] / ("0" * 64)).write_bytes(body)
    rows = files.object_store(files.inventory(spark, str(root), contents=True)).collect()
    assert sorted((r["problem"] or "") for r in rows) == ["", "path"]


def test_bodies_manifests_and_lines(spark, tmp_path):
    kept = spark.createDataFrame([("a/1", bytearray(b"abcdef"))], "path string, body binary")
    rows = spark.createDataFrame([(1, "a/1"), (2, "gone"), (3, "../a/1"), (4, "/a/1")], "id int, file string")
    got = {r["id"]: bytes(r["body"]) for r in files.bodies(rows, kept, 4).collect()}
    assert got == {1: b"abcd", 2: b"", 3: b"", 4: b""}
    snapshots = spark.createDataFrame([(1, "r", "https://a/", "0" * 64, 3)], "id long, run_id string, source_url string, digest string, bytes long")
    assets = spark.createDataFrame([(7, 1, "1" * 64, 5)], "id long, snapshot_id long, digest string, bytes long")
    row = objects.manifests(snapshots, assets).withColumn("ok", objects.valid_manifest(F.col("pages"), F.col("resources"))).first()
    assert row["ok"] and json.loads(row["payload"])["pages"][0]["digest"].startswith("sha256:")
    (tmp_path / "m.json").write_text(json.dumps({"payload": json.loads(row["payload"]), "signature": {"key": "k"}}))
    assert files.read_manifests(spark, str(tmp_path / "m.json")).select("payload.run_id").first()["run_id"] == "r"
    line = files.log_lines(spark.createDataFrame([("x", 1)], "b string, a int")).first()["value"]
    assert line == '{"a":1,"b":"x"}'


def test_renumbering(spark):
    from quarrystone.operators import upkeep

    rows = spark.createDataFrame([(1, 1, "asset_001", "text/css"), (2, 1, "asset_001", "image/png"), (3, 1, "asset_004", "image/png")], "id int, snapshot_id int, asset_id string, content_type string")
    assert [r["new_id"] for r in upkeep.renumbered(rows).orderBy("id").collect()] == ["asset_001", "asset_005", "asset_004"]
    means = {(r["asset_id"], r["kind"]): r["means"] for r in upkeep.preferred(rows).collect()}
    assert means[("asset_001", "css")] == "asset_001" and means[("asset_001", "image")] == "asset_005"


def test_write_packages(spark, tmp_path):
    kind = "package string, id string, source_url string, body string"
    pages = spark.createDataFrame([("x", "p1", "https://a/", "one"), ("x", "p2", "https://a/2", None), ("y", "p3", "https://b/", "three")], kind)
    assets = spark.createDataFrame([("p1", "a1", "css"), ("p2", "a1", "css"), ("p3", "a1", "css"), ("gone", "a9", "none")], "snapshot_id string, id string, body string").withColumn("digest", F.sha2("body", 256))
    made = packages.write_packages(str(tmp_path), "own", "site", pages, assets).orderBy("package").collect()
    assert [(r["package"], r["files"], r["pages"], r["assets"]) for r in made] == [("x", 4, 2, 1), ("y", 3, 1, 1)]
    members = packages.read_packages(spark, f"{tmp_path}/*.tar.gz")
    assert packages.verify(members).count() == 0 and sorted(p.name for p in tmp_path.iterdir()) == ["x.tar.gz", "y.tar.gz"]
    empty = packages.write_packages(str(tmp_path / "none"), "own", "site", pages.where("false"), assets)
    assert empty.count() == 0


def test_settings_and_envelopes(spark):
    lines = spark.createDataFrame([(x,) for x in ("A_1=x=y", "  # note", "", "\tB = 2 ", "1A=x", "=x", "no", "é=")], "value string")
    got = [(r["name"], r["value"], r["problem"]) for r in files.settings(lines).collect()]
    bad = (None, None, "invalid entry")
    assert got == [("A_1", "x=y", None), bad, bad, bad, bad, ("é", "", None)]
    good = {"schema": "s1", "algorithm": "Ed25519", "key_id": "k", "payload": {"a": 1}, "signature": "A" * 86}
    cases = [good, good | {"x": 1}, {k: v for k, v in good.items() if k != "schema"}, good | {"schema": "s2"}, good | {"key_id": "z"}, good | {"payload": [1]}, good | {"signature": "A"}]
    rows = spark.createDataFrame([(json.dumps(c),) for c in cases] + [("no json",)], "j string")
    found = [r[0] for r in rows.select(objects.envelope_problem(F.col("j"), "s1", F.lit("k"))).collect()]
    assert found == [None, "fields", "fields", "version", "key", "payload", "signature", "fields"]


def test_forms(spark):
    from quarrystone.functions import urls

    rows = spark.createDataFrame([("a=1&b=&a=2&c=%C3%A9+x&d",), ("",), ("x=#1",)], "b string")
    assert [r[0] for r in rows.select(urls.form_fields(F.col("b"))).collect()] == [{"a": "2", "c": "é x"}, {}, {"x": "#1"}]


def test_stored_objects_are_put_once(spark, tmp_path):
    rows = spark.createDataFrame([("one",), ("one",), ("two",)], "body string").withColumn("digest", F.sha2("body", 256))
    assert files.put_objects(rows, str(tmp_path)).count() == 2 and files.put_objects(rows, f"file:{tmp_path}").count() == 2
    found = files.object_store(files.inventory(spark, str(tmp_path), contents=True)).collect()
    assert sorted(bytes(r["body"]) for r in found) == [b"one", b"two"] and all(r["problem"] is None for r in found)


def test_jobs_without_a_retry_are_not_joined_in_one_place(spark):
    """Those that retry nothing share a null key: no join may meet it."""
    from quarrystone.operators import crawl, jobs, joins

    rows = spark.range(60_000).select("id", F.when(F.col("id") % 1000 == 1, F.col("id") - 1).when(F.col("id") % 1000 == 2, F.col("id") - 1).when(F.col("id") % 1000 == 3, F.lit(-5)).alias("retry_of"))
    kinds = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["id"]: (r["root"], r["generation"]) for r in jobs.retry_lineage(rows).where("id < 5").collect()}
        assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (3, 0), 4: (4, 0)} and jobs.retry_lineage(rows).count() == 60_000
        asked = rows.select(F.col("id").alias("job_id"), F.col("retry_of").alias("retried"), F.lit(None).cast("string").alias("start_url"), F.lit("https://a.test/").alias("site_url"))
        failed = rows.where("id < 2000").select(F.col("id").alias("retried"), F.lit("https://a.test/x").alias("url"), F.col("id").alias("pos"))
        found = crawl.seeds(asked, failed, 2, "drop", [], [])
        assert "isnull(CASE" in found._jdf.queryExecution().optimizedPlan().toString()  # rows of the null key go another way
        assert found.count() == 60_000 and found.where("url = 'https://a.test/x'").count() == 4
        assert joins.dealt(rows, "id", each=6000).rdd.getNumPartitions() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kinds)
