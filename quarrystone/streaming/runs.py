"""Streams over files that arrive in parts: each run takes what is new, ends, and the next one resumes from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import fresh_folder

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Custom state needs the RocksDB store; what was set before comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def resumed(parts: Iterable[DataFrame], transform: Callable[[DataFrame], DataFrame], key: str, files: int = 4, at_once: int = 2) -> DataFrame:
    """What a stream has written after all ``parts``, frames of one schema, have arrived one after another.

    Every part goes to the source's folder as ``files`` files, dealt by ``key``, so that a key's rows of a part lie in one file and no order of
    files within a part matters. A query then takes the new files, ``at_once`` in a micro-batch, and ends; the next part's query starts anew from the same
    checkpoint, with state and offsets as they were. The sink is exactly once: it reads back each row once, however often a run was broken off.
    """
    folder, schema, kind = None, None, None
    for rows in parts:
        spark = rows.sparkSession
        folder, schema = folder or fresh_folder(spark, "stream"), schema or rows.schema
        rows.repartition(files, key).write.mode("append").parquet(f"{folder}/source")
        stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/source"))
        kind = stream.schema
        with _state_store(spark):
            sink = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
            sink.trigger(availableNow=True).start(f"{folder}/sink").awaitTermination()
    return spark.read.schema(kind).parquet(f"{folder}/sink")
