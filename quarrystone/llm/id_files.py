"""Token-id files: independent zstandard frames, one a document, with a seek table at the end.

A file is a run of zstandard frames, then a skippable frame with the documents' ids and the
number of token ids of each, then a skippable frame in zstandard's seekable format: for
each frame its compressed size, its decompressed size and the low 32 bits of the XXH64 of its
content. Any zstandard reader reads the files whole; a reader that knows the table
decompresses only the documents it is asked for and checks each against its own checksum.

Documents are written in ascending id, a range of ids a file. A file is put in place by a rename, so a task
that runs again writes the same file again.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import file_system
from ._shared import fresh_path, written
from .tokens import tokenizer

#: Fixed values of zstandard's seekable format, and an own skippable frame for the index.
_SKIP_SEEK, _SKIP_INDEX, _SEEK_MAGIC, _CHECKSUMS = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80
#: Bytes of text that a file stands for, about; larger files suit larger clusters.
FILE_BYTES = 28_000_000
#: Files whose token counts one task adds up; their sums, a row a block, are added up in one place.
BLOCK_FILES = 4096
_NULL = -(1 << 63)


class Writer:
    """Collects one file; ``close`` puts it in place in one step."""

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.entries, self.index = [], []

    def add(self, doc_id: int | None, ids: bytes) -> int:
        """A frame for one document's little-endian 32-bit ids; their planes of bytes compress better apart."""
        planes, n = np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes(), len(ids) // 4
        frame = self.compressor.compress(planes)
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(planes), xxhash.xxh64_intdigest(planes) & 0xFFFFFFFF))
        self.index.append(struct.pack("<qI", _NULL if doc_id is None else doc_id, n))
        return n

    def close(self) -> int:
        body = b"".join(self.index)
        self.out.write(struct.pack("<II", _SKIP_INDEX, len(body)) + body)
        # the index counts as a frame of no content, so that the offsets of a plain seek reader agree
        table = b"".join(self.entries) + struct.pack("<III", 8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        foot = struct.pack("<IBI", len(self.entries) + 1, _CHECKSUMS, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _SKIP_SEEK, len(table) + len(foot)) + table + foot)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(self.entries)


class Reader:
    """Random access to one file's documents."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEK_MAGIC or flags != _CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.content, self.sums = table[:-1, 0], table[:-1, 1], table[:-1, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        body = self.file.read_at(int(table[-1, 0]) - 8, int(self.at[n - 1]) + 8)
        self.docs = np.frombuffer(body, [("doc_id", "<i8"), ("n", "<u4")])

    def __len__(self) -> int:
        return len(self.docs)

    def doc_id(self, i: int) -> int | None:
        key = int(self.docs["doc_id"][i])
        return None if key == _NULL else key

    def ids(self, i: int) -> bytes:
        """Document i's ids as little-endian 32-bit integers; its frame alone is read and checked."""
        frame = self.file.read_at(int(self.sizes[i]), int(self.at[i]))
        planes = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.content[i]))
        if xxhash.xxh64_intdigest(planes) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i}: checksum differs")
        return np.frombuffer(planes, np.uint8).reshape(4, -1).T.tobytes()

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """The ids of the documents asked for; a binary search, since doc ids ascend."""
        keys = self.docs["doc_id"]
        for d in doc_ids:
            for i in range(int(np.searchsorted(keys, d)), int(np.searchsorted(keys, d, "right"))):
                yield d, self.ids(i)


def _write(folder: str, path: str, end_id: int):
    """Texts of a range of ids, sorted: encodes and writes them, one file a partition, none if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        writer, file, tokens = None, TaskContext.get().partitionId(), 0
        target = f"{folder}/{file:08d}.zst"
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                writer = writer or Writer(target)
                tokens += writer.add(key, tok.encode(text or "") + end)
        if writer:
            yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "path": [target], "docs": [writer.close()], "tokens": [tokens]})

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest: file, path, docs, tokens, base (ids before it).

    Documents go in ascending id; a null id comes first, rows that share an id by text. Null and empty
    texts hold the end id alone. Empty table: no files. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = two.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    first = F.col("doc_id").asc_nulls_first()
    dealt = two.repartitionByRange(max(1, round(total / file_bytes)), first).sortWithinPartitions(first, F.col("text").asc_nulls_first())
    manifest = written(dealt.mapInArrow(_write(folder, tokenizer_path, end_id), "file int, path string, docs long, tokens long"), "manifest")
    return with_base(manifest)


def with_base(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``base``, the ids in all files before each: within blocks of files, and over the blocks' sums."""
    blocked = manifest.withColumn("_block", F.expr(f"file div {BLOCK_FILES}"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = blocked.groupBy("_block").agg(F.sum("tokens").alias("tokens"))
    starts = sums.select("_block", before(Window.orderBy("_block")).alias("_start"))  # one row for BLOCK_FILES files
    inside = blocked.withColumn("_at", before(Window.partitionBy("_block").orderBy("file")))
    return inside.join(starts, "_block").withColumn("base", F.col("_start") + F.col("_at")).drop("_block", "_start", "_at")


def _read(with_ids: bool):
    """Paths and bases to a row a document; without ids, only what is made of them goes back to Spark."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, start = Reader(path), base
                for lo in range(0, len(reader), 2000):
                    rows = []
                    for i in range(lo, min(lo + 2000, len(reader))):
                        ids = reader.ids(i)
                        rows.append((reader.doc_id(i), start, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                        start += len(ids) // 4
                    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document, from the files of a manifest.

    Files are dealt by their numbers to a task each, or several a task where there are many more files than
    shuffle partitions; each is read frame by frame.
    """
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(manifest.count(), 8 * parts))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return manifest.repartitionById(tasks, "file").select("path", "base").mapInArrow(_read(with_ids), kind)


def write_and_read(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    return read_ids(write_ids(docs, tokenizer_path, fresh_path(docs.sparkSession, "ids")), with_ids)
