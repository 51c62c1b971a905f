"""Best-fit packing with bounded space.

Each partition packs its pieces online into a fixed number of open bins. A bitset keyed by free
space finds, for a piece of s tokens, the bin with the least free space of s or more. Where
no open bin takes a piece, a new one opens; if that is one too many, the fullest closes first.
What is open at a partition's end is packed again, together with what other partitions left open,
bin by bin; only such bins' pieces are dealt anew.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .tokens import tokenizer

#: Tokens of a sequence, and bins that are open at a time.
CAPACITY, OPEN_BINS = 2048, 256
#: Partitions whose open bins are packed together at the end.
PARTITIONS_TOGETHER = 64


class OpenBins:
    """Open bins by free space; ``place`` gives bin and offset, and the bin that had to close."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.free_bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _pop(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            del self.by_free[free]
            self.free_bits &= ~(1 << free)
        self.count -= 1
        return b

    def place(self, size: int) -> tuple[int, int, list[int]]:
        """(bin, offset, bins that closed) for a piece of ``size`` tokens, 1 to the capacity."""
        closed, fits = [], self.free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            if self.count >= self.most:
                closed.append(self._pop((self.free_bits & -self.free_bits).bit_length() - 1))
            b, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(b)
            self.free_bits |= 1 << left
            self.count += 1
        else:
            closed.append(b)
        return b, self.capacity - free, closed


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits; else full ones, the first maybe shorter."""
    first = n if n <= capacity else n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


_PLACED = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("bin", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("fill", pa.int64())]
)
_PLACED_DDL = "doc_id long, piece int, start long, length long, ids binary, bin long, offset long, part int, fill long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACED, strict=True)], schema=_PLACED)


def _pack(path: str, end_id: int, capacity: int, most: int):
    """fill is null where a bin has closed; else the tokens in it at the partition's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, end = tokenizer(path), TaskContext.get().partitionId(), array("I", [end_id]).tobytes()
        bins, held, out, size = OpenBins(capacity, most), defaultdict(list), [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tok.encode(text or "") + end
                for i, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    at, offset, closed = bins.place(n)
                    held[at].append((key, i, start, n, ids[4 * start : 4 * (start + n)], part << 32 | at, offset, part, None))
                    size += n
                    for c in closed:
                        out += held.pop(c)
                if len(out) >= 1000:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)
        for pieces in held.values():
            fill = sum(p[3] for p in pieces)
            yield _rows([(*p[:-1], fill) for p in pieces])

    return run


def _merge(capacity: int):
    """Bins of some partitions, the fullest first, as pieces of new sequences."""

    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["fill", "bin"], ascending=[False, True])
        opened = OpenBins(capacity, len(bins) + 1)
        places = [opened.place(int(f))[:2] for f in bins["fill"]]
        ids = bins["bin"].tolist()
        first: dict[int, int] = {}
        for (b, _), one in zip(places, ids, strict=True):
            first.setdefault(b, one)  # a sequence keeps the number of the bin that opened it
        return pd.DataFrame({"bin": ids, "sequence_id": [first[b] for b, _ in places], "base": [o for _, o in places]})

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset.

    Every document ends with ``end_id``, so null and empty texts give one piece of length 1.
    Longer documents than ``capacity`` are cut, no others. Null ids and repeated rows are packed
    like others. Empty table: no rows. Other columns are neither read nor returned.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = written(two.mapInArrow(_pack(tokenizer_path, end_id, capacity, open_bins), _PLACED_DDL), "packed")
    closed = placed.where("fill is null").select("doc_id", "piece", "start", "length", "ids", F.col("bin").alias("sequence_id"), "offset")
    left = placed.where("fill is not null")
    heads = left.where("offset = 0").select("bin", "fill", F.expr(f"part div {PARTITIONS_TOGETHER}").alias("together"))
    merged = heads.groupBy("together").applyInPandas(lambda d: _merge(capacity)(d), "bin long, sequence_id long, base long")
    moved = left.join(merged, "bin").select("doc_id", "piece", "start", "length", "ids", "sequence_id", (F.col("base") + F.col("offset")).alias("offset"))
    return closed.unionByName(moved)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (one binary), doc_ids in order; a group holds at most one capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
