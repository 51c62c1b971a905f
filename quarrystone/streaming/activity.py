"""Activity as streams, and the limiter as a batch fold.

Streams need event time as TIMESTAMP; every function takes a streaming or a batch frame.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def _limit(limit: int, span: int):
    """Rows sorted by key and time: only the times of the last events let through are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = object(), deque()
        for b in batches:
            allowed = []
            for key, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != last:
                    last, kept = key, deque()
                while kept and kept[0] <= t - span:
                    kept.popleft()
                allowed.append(len(kept) < limit)
                if allowed[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(allowed, pa.bool_())], ["key", "id", "allowed"])

    return run


def limited(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """key, id, allowed: an event is let through if fewer than ``limit`` were in the ``seconds`` before it.

    Only those let through count; one exactly ``seconds`` old does not. Each verdict depends on those before, so a
    key's events pass one task in order, which holds no more than ``limit`` times of them.
    """
    rows = events.select(F.col(key).alias("key"), "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    sorted_ = rows.repartition("key").sortWithinPartitions("key", "t", "id")
    kind = StructType([rows.schema["key"], rows.schema["id"], StructField("allowed", BooleanType())])
    return sorted_.mapInArrow(_limit(limit, seconds * 1_000_000), kind).withColumnRenamed("key", key)


def tumbling(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """window start, action, n, with a watermark."""
    timed = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """actor_id, start, end, n of sessions that end after a gap."""
    timed = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "actor_id").agg(F.count("*").alias("n")).select("actor_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Limiter(StatefulProcessor):
    """The limiter with state: the times of the last events let through, by key. A micro-batch's events of one key are put in order in a worker, 16 bytes each."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", StructType([StructField("t", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, times, ids = deque(t[0] for t in self.times.get()), [], []
        for batch in rows:  # a key's batches come in any order
            times.append(batch["t"].to_numpy())
            ids.append(batch["id"].to_numpy())
        t, i = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((i, t))
        for at in range(0, len(order), 10_000):
            now = order[at : at + 10_000]
            allowed = []
            for x in t[now].tolist():
                while kept and kept[0] <= x - self.span:
                    kept.popleft()
                allowed.append(len(kept) < self.limit)
                if allowed[-1]:
                    kept.append(x)
            yield pd.DataFrame({"key": str(key[0]), "id": i[now], "allowed": allowed})
        self.times.put([(t,) for t in kept])

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """The limiter on a stream; needs the RocksDB state store."""
    timed = events.select(F.col(key).cast("string").alias("key"), "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    kind = StructType([StructField("key", StringType()), StructField("id", LongType()), StructField("allowed", BooleanType())])
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(limit, seconds), outputStructType=kind, outputMode="Append", timeMode="None")


class Frontier(StatefulProcessor):
    """A job's crawl frontier with state: addresses seen, up to a cap; each is emitted when it is first found."""

    def __init__(self, max_pages: int):
        self.max_pages = max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", StructType([StructField("url", StringType())]), StructType([StructField("rank", LongType())]))
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        room, first = self.max_pages - n, {}
        for batch in rows:  # a key's batches come in any order; only as many addresses as may still fit are held of them
            for url, seq in batch.groupby("url")["seq"].min().nsmallest(self.max_pages, keep="all").items() if room > 0 else ():
                first[url] = min(seq, first.get(url, seq))
            new = sorted((seq, url) for url, seq in first.items() if not self.seen.containsKey((url,)))
            first = {url: seq for seq, url in new[:room]}
        for url in first:
            n += 1
            self.seen.updateValue((url,), (n,))
        if first:
            yield pd.DataFrame({"job": str(key[0]), "rank": range(n - len(first) + 1, n + 1), "url": list(first)})
        self.count.update((n,))

    def close(self) -> None:
        pass


def frontier_stream(discoveries: DataFrame, max_pages: int) -> DataFrame:
    """job, rank, url from a stream of job_id, seq, url."""
    kind = StructType([StructField("job", StringType()), StructField("rank", LongType()), StructField("url", StringType())])
    rows = discoveries.select(F.col("job_id").cast("string").alias("job"), "seq", "url")
    return rows.groupBy("job").transformWithStateInPandas(statefulProcessor=Frontier(max_pages), outputStructType=kind, outputMode="Append", timeMode="None")
