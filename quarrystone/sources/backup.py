"""Backups of several tables and of stored bodies, published by one marker, and their restoration.

A backup's data lies in a folder of its own generation. It is written first, then its manifest (path, bytes and digest of every
file, a table itself), then both are read back and compared; last comes the marker, one small file that no store shows in part. So a backup without a marker
is none, however far it came, and a reader never sees a mixture of two. Restoring verifies all of it before it writes, copies file by file with their digests
taken on the way, verifies the copy, and marks it in the same way; what is incomplete or altered restores nothing.

Files are read and written in pieces by many tasks, never whole in memory; the driver reads and writes markers only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objects import inventory_diff
from .stores import file_system

FORMAT, MARKER = "archive-backup.v1", "COMPLETE"
#: Bytes that a task holds of a file at once, and rows of a table's file at most.
PIECE, ROWS_A_FILE = 4 << 20, 5_000_000
_FILE = "path string, bytes bigint, digest string"


class BackupError(RuntimeError):
    """A backup that is incomplete or altered, or a target that isn't empty."""


def _entries(path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    import pyarrow.fs

    store, root = file_system(path)
    return [f.base_name for f in store.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))]


def read_marker(path: str) -> dict | None:
    """What a complete backup says of itself; None where there is no marker, or one that isn't ours."""
    if MARKER not in _entries(path):
        return None
    store, root = file_system(path)
    try:
        with store.open_input_stream(f"{root}/{MARKER}") as f:
            marker = json.loads(f.read())
    except ValueError:
        return None
    return marker if isinstance(marker, dict) and marker.get("format") == FORMAT else None


def _write_marker(path: str, marker: dict) -> None:
    store, root = file_system(path)
    temp = f"{root}/.{MARKER}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(json.dumps(marker, sort_keys=True).encode())
    store.move(temp, f"{root}/{MARKER}")


def _each_file(folder: str, target: str | None):
    """Paths to path, bytes and digest; with ``target`` the file is copied there on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        other, there = file_system(target) if target else (None, None)
        for b in batches:
            sizes, digests = [], []
            for path in b.column(0).to_pylist():
                digest, size, out, temp = hashlib.sha256(), 0, None, None
                if other:
                    temp = f"{there}/{path}.{uuid.uuid4().hex}.part"
                    other.create_dir(f"{there}/{path}".rpartition("/")[0], recursive=True)
                    out = other.open_output_stream(temp)
                with store.open_input_stream(f"{root}/{path}") as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                        if out:
                            out.write(piece)
                if out:
                    out.close()
                    other.move(temp, f"{there}/{path}")  # a task that is run again leaves the same file
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["path", "bytes", "digest"])

    return run


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all data files below a folder, relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.select(F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1).alias("path"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, digest of all files below a folder, read in pieces by many tasks."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _paths(spark, folder).repartition(parts, "path").mapInArrow(_each_file(folder, None), _FILE)


def _sum(files: DataFrame) -> dict:
    """How many files there are, their bytes, and a check of all paths and digests that no order changes."""
    r = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.xxhash64("path", "bytes", "digest").cast("decimal(38,0)")), F.lit(0)).alias("check")).first()
    return {"files": r["files"], "bytes": int(r["bytes"]), "check": str(r["check"])}


def create(spark: SparkSession, tables: dict[str, DataFrame], path: str, about: dict | None = None) -> dict:
    """Backs up ``tables`` to ``path`` and returns the marker. Refuses a path that holds a backup; what an attempt that failed has left there is passed over.

    Stored bodies are a table as well, of digest and body.
    """
    if MARKER in _entries(path):
        raise BackupError("there is a backup already")
    generation = f"data-{uuid.uuid4().hex}"
    folder = f"{path}/{generation}"
    for name, table in tables.items():
        table.write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{folder}/tables/{name}")
    inventory(spark, folder).write.parquet(f"{path}/manifest-{generation}")
    rows = {name: spark.read.schema(t.schema).parquet(f"{folder}/tables/{name}").count() for name, t in tables.items()}
    schemas = {name: json.loads(t.schema.json()) for name, t in tables.items()}
    marker = {"format": FORMAT, "generation": generation, "about": about or {}, "rows": rows, "schemas": schemas, **_sum(_manifest(spark, path, generation))}
    if not inventory_diff(_manifest(spark, path, generation), inventory(spark, folder)).where("state <> 'ok'").isEmpty():
        raise BackupError("what was written isn't what can be read")
    _write_marker(path, marker)
    return marker


def _manifest(spark: SparkSession, path: str, generation: str) -> DataFrame:
    return spark.read.schema(_FILE).parquet(f"{path}/manifest-{generation}")


def problems(spark: SparkSession, path: str) -> DataFrame:
    """path, problem of a backup: ``incomplete`` without a marker, a manifest that isn't the marker's, files missing, added or altered. Empty if all is well."""
    kind = "path string, problem string"
    marker = read_marker(path)
    if marker is None:
        return spark.createDataFrame([(MARKER, "incomplete")], kind)
    generation = marker["generation"]
    names = set(_entries(path))
    if not {generation, f"manifest-{generation}"} <= names:
        return spark.createDataFrame([(n, "missing") for n in sorted({generation, f"manifest-{generation}"} - names)], kind)
    manifest = _manifest(spark, path, generation)
    if any(marker.get(k) != v for k, v in _sum(manifest).items()):
        return spark.createDataFrame([(f"manifest-{generation}", "altered")], kind)
    return inventory_diff(manifest, inventory(spark, f"{path}/{generation}")).where("state <> 'ok'").select("path", F.col("state").alias("problem"))


def restore(spark: SparkSession, path: str, target: str) -> dict[str, DataFrame]:
    """The tables of a backup, restored to ``target``, an absent or empty folder. Raises BackupError, and leaves no marker, for anything that isn't whole."""
    found = problems(spark, path).limit(1).collect()
    if found:
        raise BackupError(f"{found[0]['path']}: {found[0]['problem']}")
    if _entries(target):
        raise BackupError("the target isn't empty")
    marker = read_marker(path)
    generation = marker["generation"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copied = _manifest(spark, path, generation).select("path").repartition(parts, "path").mapInArrow(_each_file(f"{path}/{generation}", f"{target}/{generation}"), _FILE)
    copied.write.parquet(f"{target}/manifest-{generation}")
    if any(marker[k] != v for k, v in _sum(_manifest(spark, target, generation)).items()):
        raise BackupError("what was copied isn't what was saved")
    out = tables(spark, target, marker)
    if any(t.count() != marker["rows"][name] for name, t in out.items()):
        raise BackupError("rows are missing")
    _write_marker(target, marker)
    return out


def tables(spark: SparkSession, path: str, marker: dict | None = None) -> dict[str, DataFrame]:
    """The tables of a complete backup."""
    from pyspark.sql.types import StructType

    marker = marker or read_marker(path)
    if marker is None:
        raise BackupError("incomplete")
    return {name: spark.read.schema(StructType.fromJson(s)).parquet(f"{path}/{marker['generation']}/tables/{name}") for name, s in marker["schemas"].items()}
