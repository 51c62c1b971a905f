"""Files as tables: inventories, object stores, legacy documents, manifests, event logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StringType, StructField, StructType

from .stores import file_system

_ASSET = StructType([StructField(k, t) for k, t in (("id", StringType()), ("source_url", StringType()), ("final_url", StringType()), ("status", LongType()), ("content_type", StringType()), ("bytes", LongType()), ("file", StringType()), ("content_digest", StringType()))])
#: A legacy document: four lists of records.
DOCUMENT = StructType([
    StructField("users", ArrayType(StructType([StructField(k, StringType()) for k in ("id", "email", "name", "role", "status", "created_at", "last_login_at")]))),
    StructField("sites", ArrayType(StructType([*(StructField(k, StringType()) for k in ("id", "owner_id", "name", "url", "visibility", "interval", "created_at", "last_snapshot_at", "next_snapshot_at")), StructField("crawl_depth", LongType()), StructField("max_pages", LongType()), StructField("wayback_enabled", BooleanType())]))),
    StructField("snapshots", ArrayType(StructType([*(StructField(k, StringType()) for k in ("id", "site_id", "kind", "source_url", "final_url", "content_type", "file", "wayback_timestamp", "created_at", "created_by")), StructField("status", LongType()), StructField("bytes", LongType()), StructField("rendered", BooleanType()), StructField("assets", ArrayType(_ASSET))]))),
    StructField("events", ArrayType(StructType([StructField(k, StringType()) for k in ("id", "actor_id", "action", "detail", "created_at")]))),
])
MANIFEST = StructType([
    StructField("payload", StructType([
        StructField("run_id", StringType()),
        StructField("pages", ArrayType(StructType([StructField("id", StringType()), StructField("url", StringType()), StructField("digest", StringType()), StructField("bytes", LongType())]))),
        StructField("resources", ArrayType(StructType([StructField("id", StringType()), StructField("digest", StringType()), StructField("bytes", LongType())]))),
    ])),
    StructField("signature", MapType(StringType(), StringType())),
])


def read_document(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """The tables of legacy documents, each with ``seq`` for its place; snapshots' assets are a table of their own.

    A file is one value, which one task parses, or, with ``lines``, a value a line.
    """
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=not lines)
    out = {k: doc.select(F.posexplode(k).alias("seq", "r")).select("seq", "r.*") for k in DOCUMENT.fieldNames()}
    assets = out["snapshots"].select(F.col("id").alias("snapshot_id"), F.posexplode("assets").alias("seq", "r")).select("snapshot_id", "seq", "r.*")
    return out | {"snapshots": out["snapshots"].drop("assets"), "assets": assets}


def read_manifests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Manifest envelopes, a file each or, with ``lines``, a line each."""
    return spark.read.schema(MANIFEST).json(path, multiLine=not lines)


def documents(sites: DataFrame, snapshots: DataFrame, assets: DataFrame) -> DataFrame:
    """value: a legacy document (JSON) for each site, with its snapshots and their assets; so no document is larger than a site."""
    text = lambda d, *cols: [F.col(c).cast("string").alias(c) for c in cols]
    mine = assets.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id"), "bytes", "content_type", F.col("digest").alias("content_digest")))).alias("assets"))
    pages = snapshots.select(F.col("id").alias("snapshot_id"), "site_id", "kind", "source_url", "final_url", "content_type", "bytes").join(mine, "snapshot_id", "left")
    as_text = F.transform("assets", lambda x: x.withField("id", x["id"].cast("string")))
    record = F.struct(F.col("snapshot_id").alias("_n"), F.col("snapshot_id").cast("string").alias("id"), *text(pages, "site_id", "kind", "source_url", "final_url", "content_type"), "bytes", as_text.alias("assets"))
    of_site = pages.select("site_id", record.alias("r")).groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r.dropFields("_n")).alias("snapshots"))
    rows = sites.join(of_site, sites["id"] == of_site["site_id"], "left")
    site = F.array(F.struct(*text(sites, "id", "owner_id", "name", "url", "visibility")))
    return rows.select(F.to_json(F.struct(F.array().cast("array<struct<id:string>>").alias("users"), site.alias("sites"), F.coalesce("snapshots", F.array().cast(of_site.schema["snapshots"].dataType)).alias("snapshots"))).alias("value"))


def inventory(spark: SparkSession, folder: str, contents: bool = False) -> DataFrame:
    """path relative to the folder, bytes and, if asked for, digest and body of every regular file."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^.*" + root.rsplit("/", 1)[-1].replace(".", r"\.") + "/", "")
    cols = [path.alias("path"), F.col("length").alias("bytes")]
    return files.select(*cols, F.sha2("content", 256).alias("digest"), F.col("content").alias("body")) if contents else files.select(*cols)


def object_store(files: DataFrame) -> DataFrame:
    """Stored objects (path, bytes, digest) with ``problem``, null if there is none: ``objects/sha256/<2 hex>/<64 hex>`` that hold what their name says."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    problem = (
        F.when(F.size(parts) != 2, "path").when(F.substring(name, 1, 2) != F.element_at(parts, 1), "path").when(~name.rlike("^[0-9a-f]{64}$"), "digest name").when(name != F.col("digest"), "digest mismatch")
    )
    return files.withColumn("problem", problem)


def bodies(snapshots: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Snapshots with the first ``limit`` bytes of their file; empty where it is missing or its path unsafe."""
    safe = ~F.col("file").startswith("/") & ~F.array_contains(F.split("file", "/"), "..")
    kept = files.select(F.col("path").alias("file"), F.substring("body", 1, limit).alias("body"))
    joined = snapshots.join(kept, "file", "left")
    return joined.withColumn("body", F.when(safe, F.coalesce("body", F.lit(b""))).otherwise(F.lit(b"")))


def _put(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for b in batches:
            paths = []
            for digest, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                paths.append(f"{digest[:2]}/{digest}")
                target = f"{root}/{paths[-1]}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                temp = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(temp) as out:
                    out.write(body)
                store.move(temp, target)  # a put that is made again leaves the same object
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["digest", "path"])

    return run


def put_objects(rows: DataFrame, folder: str) -> DataFrame:
    """digest, path of the bodies (digest, body) that were put into a content-addressed store, each digest once."""
    once = rows.groupBy("digest").agg(F.first(F.col("body").cast("binary")).alias("body"))
    return once.mapInArrow(_put(folder), "digest string, path string")


def settings(lines: DataFrame) -> DataFrame:
    """name, value, problem of lines (value): ``name=value``; blank lines and comments are left out, other lines are a problem."""
    line = F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    name = F.substring_index(line, "=", 1)
    ok = line.contains("=") & name.rlike(r"^\p{L}[\p{L}\p{N}_]*$")
    rows = lines.where((line != "") & ~line.startswith("#"))
    return rows.select(*[c for c in lines.columns if c != "value"], F.when(ok, name).alias("name"), F.when(ok, F.substring(line, F.length(name) + 2, F.length(line))).alias("value"), F.when(~ok, "invalid entry").alias("problem"))


def log_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines with sorted keys, nulls left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
