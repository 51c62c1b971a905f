"""Backups restore what was saved or nothing; web-archive files are read back record by record."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import backup, warc
from quarrystone.sources.packages import warc_record


@pytest.fixture
def saved(spark):
    a = spark.range(500).select("id", F.array("id").alias("xs"), F.struct(F.lit(None).cast("string").alias("n")).alias("s"))
    return {"a": a.repartition(3), "empty": a.where("false"), "bodies": spark.createDataFrame([("d1", bytearray(b"\x00\xff" * 10)), ("d2", None)], "digest string, body binary")}


def test_backup_and_restore(spark, saved, tmp_path):
    marker = backup.create(spark, saved, f"{tmp_path}/b", {"archive": "x"})
    assert marker["rows"] == {"a": 500, "empty": 0, "bodies": 2} and marker["about"] == {"archive": "x"} and backup.problems(spark, f"{tmp_path}/b").count() == 0
    with pytest.raises(backup.BackupError):
        backup.create(spark, saved, f"{tmp_path}/b")
    back = backup.restore(spark, f"{tmp_path}/b", f"{tmp_path}/r")
    for name, table in saved.items():
        assert back[name].schema.simpleString() == table.schema.simpleString() and sorted(map(str, back[name].collect())) == sorted(map(str, table.collect()))
    assert backup.problems(spark, f"{tmp_path}/r").count() == 0 and backup.tables(spark, f"{tmp_path}/r")["a"].count() == 500
    with pytest.raises(backup.BackupError, match="empty"):
        backup.restore(spark, f"{tmp_path}/b", f"{tmp_path}/r")


@pytest.mark.parametrize("damage", ["no marker", "other marker", "changed", "longer", "gone", "added", "manifest", "no data", "broken marker"])
def test_damaged_backups_restore_nothing(spark, saved, tmp_path, damage):
    path = f"{tmp_path}/b"
    marker = backup.create(spark, saved, path)
    data = sorted(glob.glob(f"{path}/{marker['generation']}/tables/a/part-*"))[0]
    for crc in glob.glob(f"{path}/**/.*.crc", recursive=True):
        os.remove(crc)
    body = open(data, "rb").read()
    if damage == "no marker":
        os.remove(f"{path}/COMPLETE")
    elif damage in ("other marker", "broken marker"):
        open(f"{path}/COMPLETE", "w").write(json.dumps(marker | {"format": "x"}) if damage == "other marker" else "{")
    elif damage in ("changed", "longer"):
        open(data, "wb").write(body[:-9] + bytes([body[-9] ^ 1]) + body[-8:] if damage == "changed" else body + b"x")
    elif damage == "gone":
        os.remove(data)
    elif damage == "added":
        open(f"{os.path.dirname(data)}/part-x", "wb").write(b"x")
    elif damage == "manifest":
        spark.createDataFrame([("x", 1, "y")], "path string, bytes long, digest string").write.mode("append").parquet(f"{path}/manifest-{marker['generation']}")
    else:
        os.rename(f"{path}/{marker['generation']}", f"{path}/elsewhere")
    want = {"no marker": "incomplete", "other marker": "incomplete", "broken marker": "incomplete", "changed": "digest", "longer": "size", "gone": "missing", "added": "unlisted", "manifest": "altered", "no data": "missing"}
    assert [r["problem"] for r in backup.problems(spark, path).collect()] == [want[damage]]
    with pytest.raises(backup.BackupError, match=want[damage]):
        backup.restore(spark, path, f"{tmp_path}/r")
    assert not os.path.exists(f"{tmp_path}/r")


def test_a_failed_attempt_is_passed_over(spark, saved, tmp_path, monkeypatch):
    monkeypatch.setattr(backup, "_write_marker", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        backup.create(spark, saved, f"{tmp_path}/b")
    assert backup.read_marker(f"{tmp_path}/b") is None
    monkeypatch.undo()
    backup.create(spark, saved, f"{tmp_path}/b")
    assert backup.restore(spark, f"{tmp_path}/b", f"{tmp_path}/r")["a"].count() == 500


RECORD = "seq long, url string, date string, status int, content_type string, body string"


def test_archive_files(spark, tmp_path):
    pages = [(i, f"HTTP://A.test/p{i % 7}#f", f"2024-01-{i % 28 + 1:02d}T00:00:00Z", 200 + i, "text/html", "ü" * i + "\r\n\r\nWARC/1.1") for i in range(60)] + [(60, "http://b.test", "2024-01-01T00:00:00Z", None, None, None)]
    assets = [(100, "http://a.test/s", "2024-01-01T00:00:00Z", 200, "text/css", "x"), (101, "http://a.test/s", "2024-01-02T00:00:00Z", 200, "text/css", "x"), (102, "http://a.test/s", "2024-01-03T00:00:00Z", 200, "text/css", "y")]
    index = warc.write(spark.createDataFrame(pages, RECORD), spark.createDataFrame(assets, RECORD), f"{tmp_path}/w", {"by": "test"}, 3, 2000)
    assert index.count() == 63 and index.select("file").distinct().count() > 3
    got = {r["seq"]: r for r in warc.read_records(index).collect()}
    for seq, url, date, status, kind, body in pages + [assets[0], assets[2]]:
        r = got[seq]
        assert (r["url"], r["date"], r["status"], r["content_type"], bytes(r["body"]), r["problem"]) == (url, date, status or 200, kind or "application/octet-stream", (body or "").encode(), None)
    for file in glob.glob(f"{tmp_path}/w/*.warc.gz"):  # whole files are plain gzip too
        import gzip

        text = gzip.open(file).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.endswith(b"\r\n\r\n")
    wanted = spark.createDataFrame([("http://a.test/p0", "2024-01-10T00:00:00Z"), ("http://a.test/p0", "2023-01-01T00:00:00Z"), ("http://a.test/s", "2024-01-02T12:00:00Z"), ("http://b.test/", "2025"), ("http://none/", "2025")], "key string, at string")
    found = {(r["key"], r["at"]): (r["date"][:10], r["seq"]) for r in warc.captures_at(index, wanted).collect()}
    dates = sorted((d[:10], s) for s, u, d, *_ in pages if s % 7 == 0 and s < 60)
    assert found == {("http://a.test/p0", "2024-01-10T00:00:00Z"): max(x for x in dates if x[0] <= "2024-01-10"), ("http://a.test/p0", "2023-01-01T00:00:00Z"): dates[0], ("http://a.test/s", "2024-01-02T12:00:00Z"): ("2024-01-01", 100), ("http://b.test/", "2025"): ("2024-01-01", 60)}
    again = warc.write(spark.createDataFrame(pages, RECORD), spark.createDataFrame(assets, RECORD), f"{tmp_path}/w2", {"by": "test"}, 3, 2000)
    assert sorted(r["offset"] for r in again.collect()) == sorted(r["offset"] for r in index.collect())


def test_damaged_records(spark, tmp_path):
    good = warc_record("response", "http://a/", "d", "application/http", b"HTTP/1.1 200 OK\r\nContent-Type: t\r\nContent-Length: 1\r\n\r\nx")
    assert warc.parsed(good)["body"] == b"x" and warc.parsed(good[:-3])["problem"] == "no record" and warc.parsed(b"")["problem"] == "no record"
    assert warc.parsed(warc_record("response", "u", "d", "t", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nx"))["problem"] == "no whole response"
    index = spark.createDataFrame([("k", "d", 1, f"{tmp_path}/none.warc.gz", 0, 5)], "key string, date string, seq long, file string, offset long, bytes long")
    assert warc.read_records(index).first()["problem"] == "no file" and warc.read_records(index.where("false")).count() == 0


def test_shards_grow_with_the_bodies(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from quarrystone.sources import warc

    monkeypatch.setattr(warc, "TASK_BYTES", 100)
    row = lambda kind: spark.range(40).select("id", F.concat(F.lit(f"https://a.test/{kind}"), F.col("id").cast("string")).alias("url"))
    full = lambda rows, first: rows.select((F.col("id") + first).alias("seq"), "url", F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.repeat("url", F.lit(5)).alias("body"))
    index = warc.write(full(row("p"), 0), full(row("q"), 1000).where("false"), f"{tmp_path}/w", {}, 2)
    assert index.select("file").distinct().count() > 2 and index.count() == 40
    assert warc.read_records(index).where("problem is null").count() == 40
