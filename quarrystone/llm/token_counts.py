"""Token counts from distinct pre-tokens.

A text is cut into pre-tokens; how many pieces a pre-token gives does not depend on the
text around it. So pieces are counted once for each distinct pre-token of the corpus, and
a document's count is the sum over its pre-tokens of frequency times pieces. No ids of any
document are made.

Documents go in *blocks* of bounded size. A block sends its distinct pre-tokens, not those of each
document, in compressed lists, one for each bucket of their hash, and its documents'
frequencies as one compressed sparse matrix:

    documents -> blocks -> shuffle by bucket -> count once -> shuffle by block -> sum

A pre-token that every document holds is one entry a block, so no bucket is hot.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer

#: A block ends when its texts reach so many characters or its documents so many.
BLOCK_CHARS, BLOCK_DOCS = 16_000_000, 20_000
#: Distinct pre-tokens that a task remembers; beyond it some are counted again.
REMEMBERED = 1_000_000
_ROWS = "bucket int, block long, is_matrix boolean, data binary"


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays by name, their bytes in planes, which compress better apart."""
    head = json.dumps({k: [str(v.dtype), len(v)] for k, v in arrays.items()}).encode()
    planes = [np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1).T.tobytes() if len(v) else b"" for v in arrays.values()]
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(body[:4], "little")
    out = {}
    for k, (kind, n) in json.loads(body[4:at]).items():
        size = np.dtype(kind).itemsize * n
        planes = np.frombuffer(body, np.uint8, size, at).reshape(-1, n) if n else np.zeros((1, 0), np.uint8)
        out[k] = np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind)
        at += size
    return out


class _Block:
    """Documents so far: distinct pre-tokens and, for each document, which of them how often."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.ids, self.sizes, self.direct, self.ends = [], [], [], [0]
        self.cols, self.counts, self.chars = [], [], 0

    def add(self, key: int, text: str, tok) -> None:
        found, direct, places = [], 0, self.places
        for part, special in tok.spans(text):
            if special:
                direct += 1
            else:
                found += tok.pieces(part)
        at = np.fromiter((places.setdefault(p, len(places)) for p in found), np.uint32, len(found))
        cols, counts = np.unique(at, return_counts=True)
        self.ids.append(key)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.direct.append(direct)
        self.cols.append(cols)
        self.counts.append(counts.astype(np.uint32))
        self.ends.append(self.ends[-1] + len(cols))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.ids) >= BLOCK_DOCS

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The matrix, then the pre-tokens with their places, a row a bucket."""
        cols = np.concatenate(self.cols)
        starts = np.array(self.ends[:-1])[np.diff(self.ends) > 0]
        steps = np.diff(cols, prepend=np.uint32(0))  # ascending within a document; wraps around between documents
        steps[starts] = cols[starts]
        matrix = _pack(
            ids=np.array([-1 if i is None else i for i in self.ids], "<i8"), null=np.array([i is None for i in self.ids], "u1"),
            sizes=np.array(self.sizes, "<i8"), direct=np.array(self.direct, "<i8"), ends=np.array(self.ends, "<i8"),
            steps=steps, counts=np.concatenate(self.counts),
        )
        yield _batch([block % buckets], [block], [True], [matrix])
        raw = [p.encode() for p in self.places]
        of = np.fromiter((xxhash.xxh32_intdigest(p) % buckets for p in raw), np.int64, len(raw))
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            places = order[edges[k] : edges[k + 1]]
            part = sorted((raw[i], i) for i in places.tolist())
            text = b"".join(p for p, _ in part)
            data = _pack(lengths=np.array([len(p) for p, _ in part], "<u4"), places=np.array([i for _, i in part], "<u4"), text=np.frombuffer(text, "u1"))
            yield _batch([k], [block], [False], [data])


def _batch(bucket, block, is_matrix, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(is_matrix, pa.bool_()), pa.array(data, pa.binary())], ["bucket", "block", "is_matrix", "data"])


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, name, block = tokenizer(path), TaskContext.get().partitionId() << 24, _Block()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block.add(key, text or "", tok)
                if block.full():
                    yield from block.rows(name, buckets)
                    name, block = name + 1, _Block()
        if block.ids:
            yield from block.rows(name, buckets)

    return run


def _count_once(path: str):
    """All rows of a bucket are in one task, which counts each distinct pre-token when it first meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = tokenizer(path), {}
        for b in batches:
            for bucket, block, is_matrix, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not is_matrix:
                    m = _unpack(data)
                    ends = np.cumsum(m["lengths"]).tolist()
                    text, counts, at = m["text"].tobytes(), [], 0
                    for end in ends:
                        piece = text[at:end]
                        at = end
                        n = known.get(piece)
                        if n is None:
                            n = known[piece] = tok.count(piece.decode())
                        counts.append(n)
                    data = _pack(places=m["places"], pieces=np.array(counts, "<u4"))
                    if len(known) > REMEMBERED:
                        known.clear()
                yield _batch([bucket], [block], [is_matrix], [data])

    return run


def _sums(t: pa.Table) -> pa.Table:
    """One block: frequencies times pieces, summed over each document's pre-tokens."""
    lists, m = [], None
    for is_matrix, data in zip(t.column("is_matrix").to_pylist(), t.column("data").to_pylist(), strict=True):
        if is_matrix:
            m = _unpack(data)
        else:
            lists.append(_unpack(data))
    each = np.zeros(1 + max((int(x["places"].max()) for x in lists), default=0), np.int64)
    for x in lists:
        each[x["places"]] = x["pieces"]
    ends, steps = m["ends"], m["steps"].astype(np.int64)
    run = np.concatenate([[0], np.cumsum(steps)])
    cols = run[1:] - np.repeat(run[ends[:-1]], np.diff(ends))  # steps add up anew in each document
    total = np.concatenate([[0], np.cumsum(each[cols] * m["counts"], dtype=np.int64)])
    tokens = total[ends[1:]] - total[ends[:-1]] + m["direct"]
    ids = pa.array(m["ids"], mask=m["null"].astype(bool))
    return pa.table({"doc_id": ids, "n_bytes": pa.array(m["sizes"], pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, without special tokens added.

    Null or empty text: 0 bytes, 0 tokens. Null id: a row with a null id. Repeated rows: a row
    each. Very long texts: a block of their own. Empty table: no rows. Other columns of
    ``docs``, whatever their names, are neither read nor returned. Special strings inside a
    text count as the library takes them by default, as one token each.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts  # the same number for each task
    blocks = two.mapInArrow(_blocks(tokenizer_path, buckets), _ROWS)
    counted = blocks.repartitionById(parts, "bucket").mapInArrow(_count_once(tokenizer_path), _ROWS)
    return counted.groupBy("block").applyInArrow(lambda t: _sums(t), "doc_id long, n_bytes long, n_tokens long")
