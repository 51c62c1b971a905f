"""Capture packages (tar.gz with metadata, manifest and payload) and web-archive records (WARC 1.1).

A package's folder inside the tar ends in ``-capture`` or ``-site``, and its format name in the same
and a version; what stands before is the caller's. Writing streams rows to one file on the
driver, as one capture is one file; reading takes any number of packages in parallel.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objects import inventory_diff, unsafe_path
from .shared import checkpointed
from .stores import file_system


def _member(tar: tarfile.TarFile, name: str, body: bytes) -> dict:
    info = tarfile.TarInfo(name)
    info.size, info.mode = len(body), 0o600
    tar.addfile(info, io.BytesIO(body))
    return {"path": name.split("/", 1)[1], "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()}


def write_package(path: str, product: str, kind: str, about: dict, snapshots: DataFrame, assets: DataFrame) -> dict:
    """Writes one package from snapshots (id, body, ...) and assets (snapshot_id, id, digest, body, ...).

    Assets are stored once for each digest. Returns the numbers of files, pages and assets.
    """
    root, form = f"{product}-{kind}", f"{product}-{kind}-v1"
    files, pages, stored = [], [], set()
    refs: dict[str, list[dict]] = {}
    for r in assets.drop("body").orderBy("snapshot_id", "id").toLocalIterator():
        refs.setdefault(str(r["snapshot_id"]), []).append(r.asDict() | {"package_path": f"payload/assets/{r['digest']}"})
    with tarfile.open(path, "w:gz") as tar:
        for r in snapshots.orderBy("id").toLocalIterator():
            body = r["body"] if isinstance(r["body"], (bytes, bytearray)) else str(r["body"]).encode()
            name = f"payload/pages/{r['id']}"
            files.append(_member(tar, f"{root}/{name}", bytes(body)))
            pages.append({k: v for k, v in r.asDict().items() if k != "body"} | {"package_path": name, "assets": refs.get(str(r["id"]), [])})
        once = assets.groupBy("digest").agg(F.min_by("body", "id").alias("body"))
        for r in once.orderBy("digest").toLocalIterator():
            body = r["body"] if isinstance(r["body"], (bytes, bytearray)) else str(r["body"]).encode()
            files.append(_member(tar, f"{root}/payload/assets/{r['digest']}", bytes(body)))
            stored.add(r["digest"])
        archive = json.dumps({"format": form, **about, "snapshots": pages}, sort_keys=True, indent=2, default=str)
        files.append(_member(tar, f"{root}/archive.json", archive.encode()))
        manifest = json.dumps({"format": form, "files": sorted(files, key=lambda f: f["path"])}, sort_keys=True, indent=2)
        _member(tar, f"{root}/manifest.json", manifest.encode())
    return {"files": len(files), "pages": len(pages), "assets": len(stored)}


_MADE = "package string, path string, files int, pages int, assets int"


def _pack(folder: str, product: str, kind: str):
    """Rows sorted by package, pages before assets: a tar.gz for each package, written as rows come."""
    root, form = f"{product}-{kind}", f"{product}-{kind}-v1"

    def close(state: dict) -> pa.RecordBatch:
        archive = json.dumps({"format": form, "package": state["package"], "snapshots": state["pages"]}, sort_keys=True, indent=2)
        state["files"].append(_member(state["tar"], f"{root}/archive.json", archive.encode()))
        _member(state["tar"], f"{root}/manifest.json", json.dumps({"format": form, "files": sorted(state["files"], key=lambda f: f["path"])}, sort_keys=True, indent=2).encode())
        state["tar"].close()
        state["out"].close()
        state["store"].move(state["temp"], state["path"])
        sizes = [len(state["files"]), len(state["pages"]), len(state["files"]) - len(state["pages"]) - 1]
        return pa.RecordBatch.from_pydict({"package": [state["package"]], "path": [state["target"]], **{k: pa.array([n], pa.int32()) for k, n in zip(("files", "pages", "assets"), sizes, strict=True)}})

    def begin(package: str) -> dict:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/{package}.tar.gz"
        temp = f"{path}.{uuid.uuid4().hex}.part"
        out = store.open_output_stream(temp)
        return {"package": package, "store": store, "target": f"{folder}/{package}.tar.gz", "path": path, "temp": temp, "out": out, "tar": tarfile.open(fileobj=out, mode="w|gz"), "files": [], "pages": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for package, asset, name, about, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or state["package"] != package:
                    if state:
                        yield close(state)
                    state = begin(package)
                where = f"payload/{'assets' if asset else 'pages'}/{name}"
                state["files"].append(_member(state["tar"], f"{root}/{where}", body or b""))
                if not asset:
                    page = json.loads(about)
                    refs = [r | {"package_path": f"payload/assets/{r['digest']}"} for r in page.pop("assets", [])]
                    state["pages"].append(page | {"package_path": where, "assets": refs})
        if state:
            yield close(state)

    return run


def write_packages(folder: str, product: str, kind: str, snapshots: DataFrame, assets: DataFrame) -> DataFrame:
    """Writes a package for each value of ``package`` and returns package, path, files, pages, assets.

    ``snapshots`` holds package, id, body and more; ``assets`` snapshot_id, id, digest, body. An asset is stored once in a package.
    Packages are written by many tasks side by side, each row by row; a package is put in place by a rename.
    """
    refs = assets.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "digest"))).alias("assets"))
    others = [c for c in snapshots.columns if c not in ("package", "body")]
    rows = snapshots.join(refs, snapshots["id"] == refs["snapshot_id"], "left")
    about = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in others), F.coalesce("assets", F.array().cast(refs.schema["assets"].dataType)).alias("assets")))
    pages = rows.select("package", F.lit(False).alias("asset"), F.col("id").cast("string").alias("name"), about.alias("about"), F.col("body").cast("binary").alias("body"))
    mine = assets.join(snapshots.select("package", F.col("id").alias("snapshot_id")), "snapshot_id")
    once = mine.groupBy("package", F.col("digest").alias("name")).agg(F.first(F.col("body").cast("binary")).alias("body"))
    stored = once.select("package", F.lit(True).alias("asset"), "name", F.lit(None).cast("string").alias("about"), "body")
    parts = int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.unionByName(stored).repartition(parts, "package").sortWithinPartitions("package", "asset", "name")
    return dealt.mapInArrow(_pack(folder, product, kind), _MADE)


_ENTRY = "package string, path string, bytes long, digest string, safe boolean, body binary"


def _untar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for package, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                for m in tar:
                    if m.isdir():
                        continue
                    root, _, name = m.name.partition("/")
                    safe = m.isfile() and bool(name) and not m.name.startswith("/") and ".." not in m.name.split("/") and root.endswith(("-capture", "-site", "-backup"))
                    body = tar.extractfile(m).read() if m.isfile() else b""
                    yield pa.RecordBatch.from_pydict(
                        {"package": [package], "path": [name], "bytes": pa.array([len(body)], pa.int64()), "digest": [hashlib.sha256(body).hexdigest()], "safe": [safe], "body": pa.array([body], pa.binary())}
                    )


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """package, path, bytes, digest, safe, body of every member of the packages at ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_untar, _ENTRY)


_MANIFEST = "struct<format:string,files:array<struct<path:string,bytes:bigint,sha256:string>>>"
_ARCHIVE = "struct<format:string,snapshots:array<struct<id:string,source_url:string,package_path:string,assets:array<struct<id:string,digest:string,package_path:string>>>>>"


def verify(members: DataFrame) -> DataFrame:
    """package, problem: unsafe members, differences from the manifest, references without a payload.

    Packages are read once: paths, sizes, digests and the two members that are read further are written; other bodies stay behind.
    """
    told = F.when(F.col("path").isin("manifest.json", "archive.json"), F.col("body")).alias("body")
    members = checkpointed(members.select("package", "path", "bytes", "digest", "safe", told))
    listed = members.where("path = 'manifest.json'").select("package", F.from_json(F.col("body").cast("string"), _MANIFEST).alias("m"))
    expected = listed.select("package", F.explode("m.files").alias("f")).select(F.concat_ws("\n", "package", "f.path").alias("path"), "f.bytes", F.col("f.sha256").alias("digest"))
    actual = members.where("path <> 'manifest.json'").select(F.concat_ws("\n", "package", "path").alias("path"), "bytes", "digest")
    diff = inventory_diff(expected, actual).where("state <> 'ok'").select(F.substring_index("path", "\n", 1).alias("package"), F.concat_ws(" ", "state", F.substring_index("path", "\n", -1)).alias("problem"))
    unsafe = members.where(~F.col("safe") | unsafe_path(F.col("path"))).select("package", F.concat_ws(" ", F.lit("unsafe"), "path").alias("problem"))
    about = members.where("path = 'archive.json'").select("package", F.from_json(F.col("body").cast("string"), _ARCHIVE).alias("a")).select("package", F.explode("a.snapshots").alias("s"))
    refs = about.select("package", "s.package_path").unionByName(about.select("package", F.explode("s.assets").alias("x")).select("package", "x.package_path")).distinct()
    lost = refs.join(members.select("package", F.col("path").alias("package_path")), ["package", "package_path"], "left_anti").select("package", F.concat_ws(" ", F.lit("reference"), "package_path").alias("problem"))
    return diff.unionByName(unsafe).unionByName(lost)


def summary(members: DataFrame) -> DataFrame:
    """package, pages, assets, bytes."""
    of = lambda p: F.count_if(F.col("path").startswith(p))
    return members.groupBy("package").agg(of("payload/pages/").alias("pages"), of("payload/assets/").alias("assets"), F.sum("bytes").alias("bytes"))


def imported(snapshots: DataFrame, salt: str) -> DataFrame:
    """Snapshots with new ids, addresses of stored copies in their bodies rewritten, and private visibility.

    An id is a digest of salt and old id, so importing twice gives the same rows.
    """
    new = F.concat(F.lit("snap_"), F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), 1, 20))
    body = F.replace(F.col("body").cast("string"), F.concat(F.lit("/snapshots/"), F.col("id").cast("string"), F.lit("/")), F.concat(F.lit("/snapshots/"), new, F.lit("/")))
    return snapshots.withColumns({"body": body, "old_id": F.col("id")}).withColumn("id", new).withColumn("visibility", F.lit("private"))


# ---- WARC


def warc_record(kind: str, target: str, date: str, content_type: str, body: bytes) -> bytes:
    """One compressed record; its id is a digest of its content, so a record made again is the same."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {target} {date} {hashlib.sha256(body).hexdigest()}")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, "WARC-Target-URI": target, "Content-Type": content_type, "Content-Length": str(len(body))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", mtime=0)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for url, date, status, kind, body in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
            body = body or b""
            http = f"HTTP/1.1 {status or 200} Archived\r\nContent-Type: {kind or 'application/octet-stream'}\r\nContent-Length: {len(body)}\r\n\r\n".encode("ascii", "replace") + body
            out.append(warc_record("response", url, date, "application/http; msgtype=response", http))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["seq", "record"])


def warc_records(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """seq, record: a response for each page and one for each address and digest of assets.

    Both frames hold seq, url, date (ISO 8601), status, content_type, body.
    """
    cols = ["seq", "url", "date", "status", "content_type", "body"]
    binary = F.col("body").cast("binary").alias("body")
    others = [c for c in cols if c not in ("url",)]
    once = assets.withColumn("body", F.col("body").cast("binary")).groupBy("url", F.sha2(F.col("body").cast("binary"), 256).alias("digest")).agg(F.min_by(F.struct(*others), "seq").alias("r")).select("url", "r.*").select(*cols)
    rows = pages.select(*cols[:-1], binary).unionByName(once)
    return rows.withColumn("status", F.col("status").cast("int")).select(*cols).mapInArrow(_records, "seq long, record binary")


def write_warc(path: str, about: dict, date: str, records: DataFrame) -> int:
    """One file of an information record and the records by seq; returns how many there are."""
    n = 1
    with open(path, "wb") as out:
        out.write(warc_record("warcinfo", "urn:export", date, "application/json", json.dumps(about, sort_keys=True).encode()))
        for r in records.orderBy("seq").toLocalIterator():
            out.write(r["record"])
            n += 1
    return n
