"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2 bits have a value in common that differs
from each in at most 1. So every distinct fingerprint emits itself and its 64 one-bit variants;
rows meet at their variants. All fingerprints that meet at one variant lie within 2 bits of each
other, and no more than 65 can, so linking each to the smallest of its group loses no
connection, and no group's pairs are spelled out. Links are deduplicated and verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checked_broadcast, fresh_path, scratch, written

SEED, BITS, RADIUS, SHINGLE = 42, 64, 2, 3


def words_of(text: str) -> list[bytes]:
    """Words of the UTF-8 text, A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], k: int = SHINGLE) -> list[bytes]:
    """k-word shingles, repeats included; fewer words: the whole sequence; none: nothing."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    set_in = np.zeros(BITS, np.int64)
    for i in range(0, n, 255):  # sums of at most 255 ones stay within a byte
        set_in += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def simhash(text: str, k: int = SHINGLE) -> int:
    digest = xxhash.xxh64_intdigest
    found = shingles(words_of(text), k)
    return fingerprint(np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found)))


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([simhash(t or "", k) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long), one row for each row of ``docs``."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_prints(k), "doc_id long, fp long")


def ball(fp: Column, bits: int = BITS) -> Column:
    """A fingerprint and its variants within half the radius, which is one bit."""
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(bits)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(x).cast("long")) for x in flips))


def links(values: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Verified links (lo, hi) among distinct fingerprints at RADIUS or fewer bits; they connect what all pairs would.

    One shuffle, by variant; a variant's group holds at most BITS + 1 distinct fingerprints.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = values.select(F.col(fp_col).alias("fp")).repartition(parts)  # each row becomes 65 here
    met = spread.select("fp", F.explode(ball(F.col("fp"))).alias("variant"))
    lowest = F.min("fp").over(Window.partitionBy("variant"))
    found = met.withColumn("lo", lowest).where("fp > lo").select("lo", F.col("fp").alias("hi")).distinct()
    return found.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (lo, hi) is connected with.

    Alternating star contraction: each round links every node's larger neighbours, then its
    smaller ones, to the smallest node around; a logarithmic number of rounds, until only stars are left. No node's neighbours are
    collected. Both sides of each join are tables in the shared folder, so that where a node has a large share
    of all edges, adaptive execution can split its partition. A round's other tables go at its end.
    """
    spark = edges.sparkSession
    edges = written(edges.select("lo", "hi").where("lo <> hi").distinct(), "edges")
    for _ in range(rounds):
        # stars: each larger node has one smaller one, which is no larger one itself
        ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("n")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("n")).distinct())
        if ends.groupBy("node").agg(F.sum("n").alias("above"), F.count("*").alias("n")).where("above > 1 or (above = 1 and n > 1)").isEmpty():
            break
        path = fresh_path(spark, "edges")
        with scratch(spark):
            both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
            around = both.groupBy(F.col("lo").alias("node")).agg(F.min("hi").alias("m"))
            least = written(around.select("node", F.least("node", "m").alias("m")), "least")
            up = edges.join(least, edges["lo"] == least["node"]).select(F.col("m").alias("lo"), "hi")
            large = written(up.where("lo <> hi").distinct(), "large")
            down = written(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "down")
            small = large.join(down, large["hi"] == down["node"]).select(F.col("m").alias("a"), F.col("lo").alias("b")).where("a <> b")
            found = small.unionByName(down.select(F.col("m").alias("a"), F.col("node").alias("b")))
            found.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().write.option("compression", "zstd").parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
    else:
        raise RuntimeError(f"not connected after {rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def near_duplicates(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, one row for each row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other. A null id keeps its
    row and is the component's id only where no other id is in it. Repeated rows: a row each.
    Empty table: no rows. Other columns are neither read nor returned.
    """
    prints = written(fingerprints(docs, k, id_col, text_col), "prints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(values))
    grouped = values.join(joined, values.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of_value = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(of_value, "fp").select("doc_id", "fp", "component_id")


# ---- near copies by similarity of five-word shingles

#: Shingle words, least Jaccard similarity, fingerprints of a document and least bits of each.
WORDS, SIMILARITY, TABLES, TABLE_BITS = 5, 0.8, 4, 32
#: Candidates of the fingerprints that differ in a larger share of all their bits are left to the shared shingles.
MOST_DIFFER = 0.14
#: Bits of the map of a document's shingles by which pairs are sorted out that can't be similar.
MAP_BITS = 512
#: One document in so many, and the least of them that a shingle is in to count as common; at most so many count.
#: They only order shingles; which pairs are found depends on no order.
COMMON_OF, COMMON_IN, COMMON_MOST = 16, 3, 1_000_000
#: Documents of a very common shingle that meet in one place, and pairs that are looked at together.
MEET_TOGETHER, PAIRS_TOGETHER = 500, 4_000_000
#: Least members of a representative that one task verifies, and representatives that one row of a document names.
MEMBERS_TOGETHER, GOALS_TOGETHER = 100, 1000


def table_bits(documents: int) -> int:
    """Bits of a fingerprint, so many that unrelated documents seldom meet in a ball, whatever the corpus' size."""
    return min(BITS, max(TABLE_BITS, math.ceil(math.log2(max(2, documents))) + 14))


def _sketches(bits: int, k: int):
    """Digest of the word sequence, TABLES fingerprints of the set of words, cut from long hashes, and a bitmap of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_ = TABLES * bits // 8  # bytes of a word's hash that are used
        mask = (1 << bits) - 1
        for b in batches:
            keys, sigs, sizes, maps = [], [], [], []
            for text in b.column(1).to_pylist():
                hashes = _short(_hashes(text, k))
                marks = np.zeros(MAP_BITS, bool)
                marks[hashes % MAP_BITS] = True
                maps.append(np.packbits(marks, bitorder="little").view("<i8").tolist())
                sizes.append(len(hashes))
                words = words_of(text or "")
                distinct = set(words)
                keys.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                raw = b"".join([b"".join([xxhash.xxh3_128_digest(w, seed) for seed in range(-(-long_ // 16))])[:long_] for w in distinct])
                ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(distinct), long_), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if distinct else np.zeros(8 * long_, np.int64)
                whole = int.from_bytes(np.packbits(2 * ones > len(distinct), bitorder="little").tobytes(), "little")
                parts = [whole >> t * bits & mask for t in range(TABLES)]
                sigs.append([p - (1 << 64) if p >> 63 else p for p in parts])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(sigs, longs), pa.array(sizes, pa.int64()), pa.array(maps, longs)], ["doc_id", "key", "sig", "n", "map"])

    return run


def _differ(a: str, b: str) -> Column:
    """Bits in which two arrays of longs differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda z, x: z + x)


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (rep, doc_id) that can be similar: each bit in which two maps differ takes a shingle that only one document holds, and
    similar documents have few of those. None that is similar is left out."""
    of = lambda name, size, bits: sketches.select(F.col("doc_id").alias(name), F.col("n").alias(size), F.col("map").alias(bits))
    both = pairs.join(of("rep", "m", "a"), "rep").join(of("doc_id", "n", "b"), "doc_id")
    most = (1 - similarity) / (1 + similarity) * (F.col("m") + F.col("n")) + 1e-6
    return both.where((_differ("a", "b") <= most) & (F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-6)).select("rep", "doc_id")


def candidates(sketches: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """Pairs (rep, doc_id): in each table, a ball's members with its representative, if their fingerprints are near.

    One shuffle by variant serves the group's aggregate and its members. The representative is the least id, in
    every table and ball alike, so that balls of one group of copies mostly share theirs.
    """
    parts = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = F.flatten(F.transform("sig", lambda fp, t: F.transform(ball(fp, bits), lambda v: F.xxhash64(t, v))))
    known = sketches.where("doc_id is not null")  # said here, as the planner would add it on one side below and spoil the reuse
    met = known.repartition(parts).select("doc_id", F.explode(tables).alias("variant")).repartition(parts, "variant")
    groups = met.groupBy("variant").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    pairs = met.join(groups.hint("merge"), "variant").where("rep < doc_id").select("rep", "doc_id").distinct()
    of = lambda name, sig: sketches.select(F.col("doc_id").alias(name), F.col("sig").alias(sig))
    both = pairs.join(of("rep", "a"), "rep").join(of("doc_id", "b"), "doc_id")
    return both.where(_differ("a", "b") <= MOST_DIFFER * TABLES * bits).select("rep", "doc_id")


def _packed(hashes: np.ndarray) -> bytes:
    """A sorted set of 32-bit numbers as compressed steps."""
    steps = np.diff(hashes, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _hashes(text: str | None, k: int) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes."""
    found = set(shingles(words_of(text or ""), k))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def _short(hashes: np.ndarray) -> np.ndarray:
    """The sorted set of their low 32 bits, enough to compare two documents."""
    return np.unique(hashes.astype(np.uint32))


def _send(k: int):
    """A document's set of shingles to each representative that it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, goals in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = _packed(_short(_hashes(text, k)))
                rows += [(g["rep"], g["salt"], key != g["rep"], key, data) for g in goals]
                if len(rows) >= 2000:
                    yield _sent(rows)
                    rows = []
            if rows:
                yield _sent(rows)

    return run


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["rep", "salt", "member", "doc_id", "shingles"])


def _verify(similarity: float):
    """Rows sorted by representative, its own set first: each member's set is compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for b in batches:
            lo, hi = [], []
            for rep, salt, member, key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hashes = _unpacked(data)
                if not member:
                    own = {(rep, salt): hashes}
                elif (base := own.get((rep, salt))) is not None:
                    shared = len(np.intersect1d(base, hashes, assume_unique=True))
                    if shared >= similarity * (len(base) + len(hashes) - shared):
                        lo.append(min(rep, key))
                        hi.append(max(rep, key))
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["lo", "hi"])

    return run


def _verified(two: DataFrame, pairs: DataFrame, similarity: float, k: int) -> DataFrame:
    """Links (lo, hi) among ``pairs`` (rep, doc_id): those of which the sets of shingles are similar.

    A representative with many members is compared with them in several tasks, and sends its set to each; a document
    with many representatives is read several times. So neither is ever gathered in one place.
    """
    parts = int(two.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = max(MEMBERS_TOGETHER, pairs.count() // (8 * parts))
    salts = pairs.groupBy("rep").agg((F.lit(1) + F.floor(F.count("*") / together)).cast("int").alias("salts"))
    member = pairs.join(salts, "rep").select("doc_id", "rep", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    itself = salts.select(F.col("rep").alias("doc_id"), "rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    each = written(member.unionByName(itself), "goals")
    reads = each.groupBy("doc_id").agg((F.lit(1) + F.floor(F.count("*") / GOALS_TOGETHER)).alias("reads"))
    dealt = each.join(reads, "doc_id").withColumn("read", F.pmod(F.xxhash64("rep", "salt"), F.col("reads")))
    goals = written(dealt.groupBy("doc_id", "read").agg(F.collect_list(F.struct("rep", "salt")).alias("goals")).drop("read"), "goals")
    sent = two.join(checked_broadcast(goals, F.lit(64) + 48 * F.size("goals")), "doc_id").select("doc_id", "text", "goals").mapInArrow(_send(k), "rep long, salt int, member boolean, doc_id long, shingles binary")
    sorted_ = sent.repartition(parts, "rep", "salt").sortWithinPartitions("rep", "salt", "member")
    return written(sorted_.mapInArrow(_verify(similarity), "lo long, hi long"), "links")


def _all_shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(text, k).view(np.int64))], ["shingle"])

    return run


def _among(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted ``common``, looked up one by one, as it may be far longer."""
    if not len(common):
        return np.zeros(len(hashes), bool)
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes


def _prefixes(similarity: float, k: int, common: np.ndarray, hot: np.ndarray):
    """A document's first shingles, the common ones ordered last: so many that a similar set shares one of them.

    ``sizes`` holds the set's size and, in its lower half, how many shingles are left from this one on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for key, text, root in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = _hashes(text, k)
                n = len(hashes)
                if not n:
                    continue
                last = _among(hashes, common)
                first = np.concatenate([hashes[~last], hashes[last]])[: n - math.ceil(similarity * n - 1e-9) + 1]
                m = len(first)
                rows.append((first.view(np.int64), np.full(m, key), np.full(m, root), (n << 32) + n - np.arange(m), _among(first, hot)))
                held += m
                if held >= 100_000:
                    yield _stacked(rows, _PREFIX)
                    rows, held = [], 0
            if rows:
                yield _stacked(rows, _PREFIX)

    return run


_PREFIX, _PAIR = ["shingle", "doc_id", "root", "sizes", "hot"], ["rep", "doc_id"]


def _stacked(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in zip(*rows, strict=True)], names)


def _meet(similarity: float):
    """Rows sorted by shingle and cell: pairs of documents there that may be similar and aren't connected yet.

    No more shingles can be shared than are left from this one on, if it is the first that is. Within a
    cell either all documents are compared (side -1), or those of different sides.
    """

    def pairs_of(side, key, root, sizes) -> Iterator[pa.RecordBatch]:
        order = np.argsort(root, kind="stable")
        side, key, root, n, rest = side[order], key[order], root[order], sizes[order] >> 32, sizes[order] & 0xFFFFFFFF
        largest = root[np.argmax(np.searchsorted(root, root, "right") - np.searchsorted(root, root))]  # its members need no comparison with each other
        rows = np.flatnonzero(root != largest)
        step = max(1, PAIRS_TOGETHER // len(key))
        for at in range(0, len(rows), step):
            one = rows[at : at + step]
            least = similarity / (1 + similarity) * (n[one, None] + n[None, :]) - 1e-6
            hit = (root[one, None] != root[None, :]) & (np.minimum(rest[one, None], rest[None, :]) >= least) & ((side[one, None] != side[None, :]) | (side[one, None] < 0))
            i, j = np.nonzero(hit)
            if len(i):
                a, b = key[one[i]], key[j]
                yield _stacked([(np.minimum(a, b), np.maximum(a, b))], _PAIR)

    def groups(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingle, cell, _, _, root, _ = held
        if not len(shingle):
            return
        starts = np.flatnonzero((np.diff(shingle, prepend=shingle[0] - 1) != 0) | (np.diff(cell, prepend=cell[0]) != 0))
        ends = np.append(starts[1:], len(shingle))
        for g in np.flatnonzero(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)):
            yield from pairs_of(*(c[starts[g] : ends[g]] for c in held[2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # batches from the start of the last shingle's last cell on
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            kept.append(cols)
            if (cols[0][-1], cols[1][-1]) != (kept[0][0][0], kept[0][1][0]):
                whole = [np.concatenate(c) for c in zip(*kept, strict=True)]
                low = np.searchsorted(whole[0], whole[0][-1])
                cut = low + np.searchsorted(whole[1][low:], whole[1][-1])
                yield from groups([c[:cut] for c in whole])
                kept = [[c[cut:] for c in whole]]
        if kept:
            yield from groups([np.concatenate(c) for c in zip(*kept, strict=True)])

    return run


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (shingle, doc_id, root, sizes) of shingles in which documents of several roots meet, with ``cell`` and ``side``.

    A shingle of MEET_TOGETHER rows or fewer is one cell. Of a larger one the most frequent root's rows and all
    others are dealt to blocks, the first to be compared with every block of the others, those with each other; a
    cell holds two blocks.
    """
    roots = rows.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    met = roots.groupBy("shingle").agg(F.sum("c").alias("c"), F.max("c").alias("most"), F.max_by("root", "c").alias("top"), F.count("*").alias("roots")).where("roots > 1")
    live = written(met.select("shingle", "c", "most", "top"), "live")
    kept = rows.join(checked_broadcast(live), "shingle")
    blocks = lambda c: F.ceil(c / MEET_TOGETHER).cast("int")
    a, b = blocks(F.col("most")), blocks(F.col("c") - F.col("most"))
    here = F.pmod(F.xxhash64("doc_id"), F.when(F.col("root") == F.col("top"), a).otherwise(b)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    spot = lambda cell, side: F.struct(cell.cast("long").alias("cell"), side.cast("long").alias("side"))
    with_others = F.transform(upto(b), lambda j: spot(here * b + j, F.lit(0)))
    with_top = F.transform(upto(a), lambda i: spot(i * b + here, F.lit(1)))
    each_other = F.transform(upto(b), lambda j: spot(a * b + F.least(here, j) * b + F.greatest(here, j), F.when(here == j, -1).otherwise(here)))
    spots = F.when(F.col("c") <= MEET_TOGETHER, F.array(spot(F.lit(0), F.lit(-1)))).when(F.col("root") == F.col("top"), with_others).otherwise(F.concat(with_top, each_other))
    return kept.select("shingle", F.explode(spots).alias("s"), "doc_id", "root", "sizes").select("shingle", "s.cell", "s.side", "doc_id", "root", "sizes")


def shared_shingles(two: DataFrame, roots: DataFrame, similarity: float, k: int) -> DataFrame:
    """Pairs (rep, doc_id) not connected yet, among which are all whose sets of shingles are similar.

    In any one order of the shingles, two sets of similarity s or more have one in common among the first
    (1 - s) n + 1 of each. Common shingles come last, so that few documents meet at one, and those in which very many
    may meet are split into cells. ``roots`` (doc_id, root) holds what is connected; a null root leaves a document out.
    """
    spark = two.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = two.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_OF)) == 0).select("text").mapInArrow(_all_shingles(k), "shingle long")
    often = sample.groupBy("shingle").count().where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "shingle").limit(COMMON_MOST).toArrow()
    found, counts = often["shingle"].to_numpy().astype(np.int64).view(np.uint64), often["count"].to_numpy()
    common, hot = np.sort(found), np.sort(found[counts >= MEET_TOGETHER // (2 * COMMON_OF)])
    known = two.join(checked_broadcast(roots.withColumn("known", F.lit(True))), "doc_id", "left").where("known is null or root is not null")
    kind = "shingle long, doc_id long, root long, sizes long, hot long"
    rows = written(known.select("doc_id", "text", F.coalesce("root", "doc_id").alias("root")).mapInArrow(_prefixes(similarity, k, common, hot), kind), "prefixes")
    others = rows.where("hot = 0").select("shingle", F.lit(0).cast("long").alias("cell"), F.lit(-1).cast("long").alias("side"), "doc_id", "root", "sizes")
    met = others.unionByName(_cells(rows.where("hot = 1").drop("hot"))).repartition(parts, "shingle", "cell").sortWithinPartitions("shingle", "cell")
    return met.mapInArrow(_meet(similarity), "rep long, doc_id long").distinct()


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: documents joined by links of Jaccard similarity on k-word shingles.

    First candidates are texts of which one of TABLES fingerprints of the set of words meets in a
    ball; they connect most copies. All other pairs that can be similar meet at a shared shingle. Each is
    verified on the sets of its shingles' hashes. Texts with the same words are one
    class. Null and empty texts, which have no words, are one class too. Rows with a null id are left
    out, for lack of a name; an id is taken to name one text. Empty table: no rows. Other columns are
    neither read nor returned.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    bits = table_bits(two.count())
    prints = written(two.mapInArrow(_sketches(bits, k), "doc_id long, key string, sig array<long>, n long, map array<long>"), "sketches")
    classes = written(prints.groupBy("key").agg(F.min_by(F.struct("doc_id", "sig", "n", "map"), "doc_id").alias("r")).select("key", F.col("r.doc_id").alias("first"), "r.sig", "r.n", "r.map"), "classes")
    sketches = classes.where("n > 0").select(F.col("first").alias("doc_id"), "sig", "n", "map")
    pairs = written(possible(candidates(sketches.select("doc_id", "sig"), bits), sketches, similarity), "pairs")
    links_ = _verified(two, pairs, similarity, k)
    connected = written(components(links_), "connected")
    copies = prints.select("doc_id", "key").join(classes.select("key", "first"), "key").where("doc_id <> first").select("doc_id", F.lit(None).cast("long").alias("root")).distinct()
    roots = written(connected.select(F.col("node").alias("doc_id"), "root").unionByName(copies), "roots")
    path = fresh_path(docs.sparkSession, "more-pairs")
    with scratch(docs.sparkSession):  # the shingles' tables are the largest, and no longer needed
        possible(shared_shingles(two, roots, similarity, k), sketches, similarity).write.option("compression", "zstd").parquet(path)
    more = docs.sparkSession.read.schema("rep long, doc_id long").parquet(path)
    again = connected.select(F.col("root").alias("lo"), F.col("node").alias("hi")).where("lo <> hi")  # stars stand for the links known before
    joined = components(again.unionByName(_verified(two, more, similarity, k)))
    of_class = classes.join(joined, classes["first"] == joined["node"], "left").select("key", F.coalesce("root", "first").alias("component_id"))
    return prints.select("doc_id", "key").join(of_class, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document, that of the least id, of each group; all columns stay.

    Rows with a null id stay. Of rows that share an id one stays.
    """
    groups = written(similar_groups(docs, similarity, id_col=id_col, text_col=text_col), "groups")
    extra = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    out = docs.join(checked_broadcast(extra), id_col, "left_anti").select(*docs.columns)
    if not groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.where(F.col(id_col).isNull()).unionByName(out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
    return out
