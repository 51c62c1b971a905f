"""Web-archive files in shards, with an index of where each record lies, and readers that seek single records.

Records are gzip members of their own, so one can be read without those before it. Rows are dealt by address and sorted by address and time; a
task writes files of bounded size under names that its partition alone sets, each put in place by a rename, so a task that is run again leaves the same
files. The index is a table (key, date, file, offset, bytes) that joins and sorts like any other.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import replay_link_key
from .packages import warc_record, warc_records
from .stores import file_system

#: Compressed bytes of a file, about.
FILE_BYTES = 1 << 30
#: Bytes of bodies that a task writes, and of records that it reads back, about.
TASK_BYTES = 128 << 20
_PLACE = "key string, date string, seq bigint, file string, offset bigint, bytes bigint"
_RECORD = "key string, date string, seq bigint, url string, kind string, status int, content_type string, body binary, problem string"


def _write(folder: str, about: str, most: int):
    """Sorted rows of key, date, seq, record: files, and where each record went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        part, n, out, places, at = TaskContext.get().partitionId(), 0, None, [], 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(temp, f"{root}/{name}")
            return pa.RecordBatch.from_pylist(places, schema=pa.schema([("key", pa.string()), ("date", pa.string()), ("seq", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for key, date, seq, record in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{part:05d}-{n:05d}.warc.gz"
                    temp = f"{root}/.{name}.{uuid.uuid4().hex}"
                    out, places = store.open_output_stream(temp), []
                    head = warc_record("warcinfo", f"urn:file:{name}", "1970-01-01T00:00:00Z", "application/json", about.encode())
                    out.write(head)
                    at, n = len(head), n + 1
                out.write(record)
                places.append({"key": key, "date": date, "seq": seq, "file": f"{folder}/{name}", "offset": at, "bytes": len(record)})
                at += len(record)
                if at >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write(pages: DataFrame, assets: DataFrame, folder: str, about: dict, shards: int, most: int = FILE_BYTES) -> DataFrame:
    """Writes the records of pages and assets (seq, url, date, status, content_type, body) and returns their index, which is a table at ``folder``/index.

    An address's assets are kept once for each content. ``key`` is the address without fragment, scheme and host in small letters. ``shards`` tasks
    write, or as many as there are TASK_BYTES of bodies, if these are more.
    """
    size = pages.select("body").unionByName(assets.select("body")).agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    shards = max(shards, -(-size // TASK_BYTES))
    named = pages.select("seq", "url", "date").unionByName(assets.select("seq", "url", "date"))
    keys = named.select("seq", replay_link_key(F.col("url")).alias("key"), "date")
    rows = warc_records(pages, assets).join(keys, "seq").select("key", "date", "seq", "record")
    salt = F.pmod(F.xxhash64("key", "seq"), F.lit(max(8, shards)))  # one address may have very many captures
    dealt = rows.repartition(shards, "key", salt).sortWithinPartitions("key", "date", "seq")
    dealt.mapInArrow(_write(folder, json.dumps(about, sort_keys=True), most), _PLACE).write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark, folder: str) -> DataFrame:
    return spark.read.schema(_PLACE).parquet(f"{folder}/index")


def _head(text: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields of a block of headers."""
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(member: bytes) -> dict:
    """One record's address, kind, status, content type and body, or the problem with it."""
    try:
        whole = gzip.decompress(member)
        top, _, rest = whole.partition(b"\r\n\r\n")
        version, fields = _head(top)
        size = int(fields["content-length"])
        if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
            return {"problem": "no whole record"}
        out = {"url": fields["warc-target-uri"], "kind": fields["warc-type"], "content_type": fields["content-type"], "body": rest[:size]}
        if out["kind"] == "response":
            http, _, body = rest[:size].partition(b"\r\n\r\n")
            status, about = _head(http)
            if int(about["content-length"]) != len(body):
                return {"problem": "no whole response"}
            out |= {"status": int(status.split(" ")[1]), "content_type": about["content-type"], "body": body}
        return out
    except (OSError, EOFError, ValueError, KeyError, IndexError):
        return {"problem": "no record"}


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows sorted by file and offset; a file is opened once for those that follow each other."""
    kind = pa.schema([("key", pa.string()), ("date", pa.string()), ("seq", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("problem", pa.string())])
    opened = handle = None
    for b in batches:
        for key, date, seq, file, offset, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = {"problem": "no file"}
            try:
                if file != opened:
                    if handle:
                        handle.close()
                    store, path = file_system(file)
                    opened, handle = None, None
                    handle, opened = store.open_input_file(path), file
                handle.seek(offset)
                found = parsed(handle.read(size))
            except OSError:
                pass
            yield pa.RecordBatch.from_pylist([{"key": key, "date": date, "seq": seq} | found], schema=kind)
    if handle:
        handle.close()


def read_records(places: DataFrame) -> DataFrame:
    """The records at some rows of an index, each read by itself; ``problem`` says what is wrong with one, and is null for those that are whole."""
    cols = ["key", "date", "seq", "file", "offset", "bytes"]
    piece = F.floor(F.col("offset") / TASK_BYTES)  # a large file is read by several tasks
    return places.select(*cols).repartition("file", piece).sortWithinPartitions("file", "offset").mapInArrow(_seek, _RECORD)


def captures_at(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row of ``wanted`` (key, at) the last place of the key's captures at or before ``at`` (ISO 8601); without one, the first after. Keys that were never captured give no row."""
    near = index.join(wanted.select("key", "at").distinct(), "key")
    before = F.max_by(F.when(F.col("date") <= F.col("at"), F.struct("date", "seq", "file", "offset", "bytes")), F.when(F.col("date") <= F.col("at"), F.struct("date", "seq")))
    after = F.min_by(F.struct("date", "seq", "file", "offset", "bytes"), F.struct("date", "seq"))
    found = near.groupBy("key", "at").agg(F.coalesce(before, after).alias("p"))
    return found.select("key", "at", "p.date", "p.seq", "p.file", "p.offset", "p.bytes")
