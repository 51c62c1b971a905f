"""Periodic runs of words: maximal stretches that repeat a root, by the runs theorem.

Every run holds a root that is the longest Lyndon word at its own start, under the order of words or under the
opposite one. So each position has two candidates: the longest Lyndon word there ends before the next smaller value of the
inverse suffix array of that order. A candidate is extended to both sides by what its ends have in common, which is the
least of the LCP array between two suffixes: a sparse table answers that at once, one of the texts for the
right and one of the texts read backwards for the left.

All steps are array operations over the words of many documents at once, each with an alphabet of its own, so no
suffix of one is like any of another; a document longer than WORDS is worked on alone. Suffixes are sorted by prefix doubling, only
those that are not yet told apart. A run of at least ``least`` words and ``times`` periods gives two suffixes that share
least * (times - 1) / times words; where the sorting has told all suffixes of a document apart by fewer words, it has no such run and the rest is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are worked on together; memory is about 500 bytes for each, or for each word of a longer document.
WORDS = 100_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Layout:
    """Several documents' words in a row: where the document of each word begins and ends, and the length of the longest."""

    def __init__(self, sizes: list[int]):
        self.ends = np.repeat(np.cumsum(sizes), sizes)
        self.begins = self.ends - np.repeat(sizes, sizes)
        self.at, self.longest = np.arange(len(self.ends)), max(sizes, default=0)


def suffix_ranks(ids: np.ndarray, ends: np.ndarray, enough: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, and the suffixes not told apart by the last of these.

    ``ids`` are dense and no two documents share any; a suffix that is the beginning of another is the smaller. Goes on until all
    suffixes differ, when the last ranks are the inverse suffix array, or until ``enough`` words are compared.
    """
    n = len(ids)
    counts = np.bincount(ids)
    rank = (np.cumsum(counts) - counts)[ids]
    levels, left, width = [rank], np.flatnonzero(counts[ids] > 1), 1
    while len(left) and (enough is None or width < enough):
        after = np.where(left + width < ends[left], rank[np.minimum(left + width, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key, left = key[order], left[order]
        group, place = rank[left], np.arange(len(left))
        fresh, older = np.r_[True, key[1:] != key[:-1]], np.r_[True, group[1:] != group[:-1]]
        rank = rank.copy()
        rank[left] = group + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(older, place, 0))
        left = left[~(fresh & np.r_[fresh[1:], True])]
        levels.append(rank)
        width *= 2
    return levels, left


def least_table(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Least values of all ranges of 1, 2, 4, ... places, up to ``longest``."""
    table, width = [values], 1
    while 2 * width <= min(longest, len(values)):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def next_smaller(isa: np.ndarray, words: Layout) -> np.ndarray:
    """For each place the next one of its document with a smaller value, else the document's end."""
    table, to = least_table(isa, words.longest), words.at + 1
    for k in reversed(range(len(table))):
        fits = np.flatnonzero(to + (1 << k) <= words.ends)
        to[fits[table[k][to[fits]] > isa[fits]]] += 1 << k
    return to


class Extensions:
    """How many words two suffixes have in common: the least LCP between their places in the suffix array."""

    def __init__(self, ids: np.ndarray, words: Layout):
        levels, _ = suffix_ranks(ids, words.ends)
        self.isa, n = levels[-1], len(ids)
        suffixes = np.empty(n, np.int64)
        suffixes[self.isa] = words.at
        a, b = suffixes[:-1], suffixes[1:]
        shared = np.zeros(max(n - 1, 0), np.int64)
        for k in reversed(range(len(levels))):
            x, y = a + shared, b + shared
            inside = np.flatnonzero((x < words.ends[a]) & (y < words.ends[b]))
            shared[inside[levels[k][x[inside]] == levels[k][y[inside]]]] += 1 << k
        self.table = least_table(shared, words.longest)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For two different suffixes of one document each."""
        lo, hi = np.minimum(self.isa[a], self.isa[b]), np.maximum(self.isa[a], self.isa[b])
        level, out = np.frexp((hi - lo).astype(float))[1] - 1, np.empty(len(lo), np.int64)
        for k, least in enumerate(self.table):
            m = np.flatnonzero(level == k)
            out[m] = np.minimum(least[lo[m]], least[hi[m] - (1 << k)])
        return out


def runs_of(ids: np.ndarray, words: Layout, least: int, times: int) -> np.ndarray:
    """All runs of ``least`` words and ``times`` periods or more, as rows of (first place, period, place after the last), sorted."""
    turned = words.begins + words.ends - 1 - words.at
    right, left = Extensions(ids, words), Extensions(ids[turned], words)
    opposite, _ = suffix_ranks(ids.max() - ids, words.ends)
    found = []
    for isa in (right.isa, opposite[-1]):
        to = next_smaller(isa, words)
        start, stop = words.at.copy(), to.copy()
        m = np.flatnonzero(to < words.ends)
        stop[m] += right.common(m, to[m])
        m = np.flatnonzero(words.at > words.begins)
        start[m] -= left.common(turned[m - 1], turned[to[m] - 1])
        period = to - words.at
        kept = stop - start >= np.maximum(least, times * period)
        found.append(np.stack([start, period, stop], axis=1)[kept])
    return np.unique(np.concatenate(found), axis=0)


def _dense(words: list[bytes]) -> list[int]:
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def _alphabets(documents: list[np.ndarray]) -> np.ndarray:
    """The ids of several documents in a row, none shared by two."""
    before = np.cumsum([0, *(d.max() + 1 for d in documents[:-1])])
    return np.concatenate([d + b for d, b in zip(documents, before, strict=True)])


def find_runs(documents: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    shared = -(-least * (times - 1) // times)
    long = [i for i, d in enumerate(documents) if len(d) >= least]
    if not long:
        return out
    ids = [np.asarray(_dense(documents[i]), np.int64) for i in long]
    words = Layout([len(d) for d in ids])
    _, same = suffix_ranks(_alphabets(ids), words.ends, 1 << (shared.bit_length() - 1))
    first = np.cumsum([0, *(len(d) for d in ids[:-1])])
    with_runs = np.unique(np.searchsorted(first, same, "right") - 1)
    if not len(with_runs):
        return out
    left = [ids[i] for i in with_runs]
    first = np.cumsum([0, *(len(d) for d in left[:-1])])
    for start, period, stop in runs_of(_alphabets(left), Layout([len(d) for d in left]), least, times).tolist():
        i = int(np.searchsorted(first, start, "right")) - 1
        out[long[with_runs[i]]].append((start - int(first[i]), stop - start, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """A row per row of ``docs``: its id, its ``runs`` (start, length, period; in words from 0), and ``collapsed``, the text without repetitions.

    Words are what lies between spaces and the characters 9 to 13. A run is a stretch with smallest period q and at least
    max(least, times * q) words, ``times`` 2 or more, that no neighbouring word extends. ``collapsed`` drops each word that a run holds after its first q words
    and joins the rest by a space. Null, empty and blank texts have no run and an empty ``collapsed``; rows
    are judged one by one, so repeated rows, null ids and further columns, which aren't returned, change nothing. No shuffle.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two periods and two words at least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < len(texts):
                hi, size, documents = lo, 0, []
                while hi < len(texts) and size < WORDS:
                    documents.append((texts[hi].as_py() or b"").split())
                    size += len(documents[-1])
                    hi += 1
                runs = find_runs(documents, least, times)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in each] for each in runs]
                kept = [b" ".join(collapsed(d, r)) for d, r in zip(documents, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(rows, _RUNS), pa.array(kept, pa.binary())], names=["key", "runs", "kept"])
                lo = hi

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(work, f"key {rows.schema[0].dataType.simpleString()}, runs array<{RUN}>, kept binary")
    return found.select(F.col("key").alias(id_col), "runs", F.col("kept").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first, then the shortest period. Null without runs."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]  # noqa: E731  runs are sorted, so only a greater one replaces
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))


def with_repetitions(text: Column, key: Column) -> Column:
    """``text``, with a tail of every tenth document by CRC-32 of its id replaced by repetitions of the tail's beginning.

    With h the CRC-32 of the id's digits, g = h div 10 and n words: where h mod 10 is 0, each word i from a = g mod n on gives way to word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    root = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)
