"""Whitening of embeddings by principal components from a hierarchical merge of singular value decompositions.

Each partition keeps the number of its vectors, their exact sums and mean, and all singular values and right vectors of the
centred vectors: at most as many rows as there are dimensions, whatever the partition holds. Two such states merge without loss: their
scaled vectors are stacked, a row is appended that stands for the difference of the means, and the stack is
decomposed anew. Partitions merge FAN at a time, level by level, in tasks of bounded size; nothing is truncated, so the last state gives
the covariance of all vectors to double precision. The driver gets that one state, of (dimensions)^2 numbers.

Vectors are integers, floor(SCALE * c) + OFFSET, so that sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

SCALE, OFFSET = 64, 1_000_000
#: Integers stay within this, so that sums over up to 2^22 times as many vectors as usual fit in a long.
LARGEST = 1 << 40
#: Vectors that a partition decomposes at once; states that a task merges.
ROWS, FAN = 4096, 16
_STATE = "part bigint, n bigint, sums array<bigint>, mean array<double>, scale array<double>, vectors array<double>"


@dataclass
class State:
    """Vectors seen so far: how many, their exact sums if they are integers, their mean, singular values and right vectors."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return self.scale[:, None] * self.vectors


def state_of(vectors: np.ndarray) -> State:
    """The state of one block of vectors, integers or doubles."""
    n = len(vectors)
    if vectors.dtype.kind == "i":
        sums = vectors.sum(axis=0)
        centred, mean = (n * vectors - sums) / n, sums / n
    else:
        sums, mean = None, vectors.mean(axis=0)
        centred = vectors - mean
    _, scale, right = np.linalg.svd(centred, full_matrices=False)
    return State(n, sums, mean, scale, right)


def merge(a: State, b: State) -> State:
    """The state of both: their rows and one for the difference of the means, decomposed anew."""
    n = a.n + b.n
    if a.sums is not None and b.sums is not None:
        apart = [int(x) * b.n - int(y) * a.n for x, y in zip(a.sums, b.sums, strict=True)]  # exact, whatever the sizes
        apart = np.array([x / (a.n * b.n) for x in apart])
        sums = a.sums + b.sums
        mean = sums / n
    else:
        sums, apart, mean = None, a.mean - b.mean, (a.n * a.mean + b.n * b.mean) / n
    correction = np.sqrt(a.n / n * b.n) * apart
    _, scale, right = np.linalg.svd(np.vstack([a.rows, b.rows, correction]), full_matrices=False)
    return State(n, sums, mean, scale, right)


def _row(part: int, s: State) -> dict:
    return {"part": part, "n": s.n, "sums": None if s.sums is None else s.sums.tolist(), "mean": s.mean.tolist(), "scale": s.scale.tolist(), "vectors": s.vectors.ravel().tolist()}


def _state(r) -> State:
    return State(int(r["n"]), None if r["sums"] is None else np.asarray(r["sums"], np.int64), np.asarray(r["mean"]), np.asarray(r["scale"]), np.asarray(r["vectors"]).reshape(len(r["scale"]), -1))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors of an Arrow column of lists."""
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)) + OFFSET
    return np.clip(values, -LARGEST, LARGEST).astype(np.int64)


def merged(rows: DataFrame, dims: int, view: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> State | None:
    """The state of all ``rows``, a frame of one column of vectors, each seen through ``view``; None without rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, schema = None, pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), *((name, pa.list_(pa.float64())) for name in ("mean", "scale", "vectors"))])
        for batch in batches:
            vectors = view(_matrix(batch.column(0), dims))
            for lo in range(0, len(vectors), ROWS):
                block = state_of(vectors[lo : lo + ROWS])
                state = merge(state, block) if state else block
        if state:
            yield pa.RecordBatch.from_pylist([_row(TaskContext.get().partitionId(), state)], schema=schema)

    def together(states: pd.DataFrame) -> pd.DataFrame:
        one, *others = (_state(r) for r in states.sort_values("part").to_dict("records"))
        for other in others:
            one = merge(one, other)
        return pd.DataFrame([_row(int(states["part"].min()) // FAN, one)])

    states = written(rows.mapInArrow(local, _STATE), "states")
    last = states.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while True:
        states = states.groupBy(F.expr(f"part div {FAN}")).applyInPandas(together, _STATE)
        last //= FAN
        if last == 0:
            return _state(states.first().asDict())


@dataclass
class Model:
    """The whitening of a table: count, sums, eigenvalues and unit eigenvectors (rows) of all dimensions, and the largest error of the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    error: float = 0.0

    @property
    def explained(self) -> list[float]:
        total = float(self.values.sum())
        return [float(v / total) if total else 0.0 for v in self.values]

    def projection(self, most: int) -> np.ndarray:
        """Columns that whiten a centred vector; NaN where a component has no variance."""
        usable = self.values[:most] > self.values[0] * len(self.values) * np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(usable, self.vectors[:most].T / np.sqrt(self.values[:most]), np.nan)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _rows(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    rows = table.select(F.col(id_col).alias("key"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(usable(F.col("vec"))).withColumn("size", F.size("vec"))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = sizes["size"] if sizes else 0
    return rows.where(F.col("size") == dims).drop("size"), dims


def fit(table: DataFrame, most: int = 32, vec_col: str = "embedding", id_col: str = "vec_id") -> Model | None:
    """The model of all usable vectors of ``table``, its error measured on the whitened vectors themselves; None if there are none."""
    rows, dims = _rows(table, id_col, vec_col)
    return _fit(rows.select("vec"), dims, most)


def _fit(vectors: DataFrame, dims: int, most: int) -> Model | None:
    state = merged(vectors, dims) if dims else None
    if state is None:
        return None
    missing = max(dims - len(state.scale), 0)  # fewer vectors than dimensions: the rest of an orthogonal basis has no variance
    right = np.linalg.svd(state.vectors, full_matrices=True)[2] if missing else state.vectors
    right = np.vstack([state.vectors, right[len(state.scale) :]]) if missing else right
    values = np.r_[state.scale, np.zeros(missing)] ** 2 / state.n
    right = right * np.where(np.take_along_axis(right, np.abs(right).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    model = Model(state.n, state.sums, values, right)
    project = model.projection(most)
    project = project[:, ~np.isnan(project).any(axis=0)]
    if project.shape[1]:
        n, sums = model.n, model.sums
        white = merged(vectors, dims, lambda x: (n * x - sums) / n @ project)
        model.error = float(np.abs(white.rows.T @ white.rows / n - np.eye(project.shape[1])).max())
    return model


def whiten(table: DataFrame, most: int = 32, vec_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, Model | None]:
    """A row per usable vector: id, ``deviation`` and ``whitened``, its first ``most`` components; and the model.

    A vector is usable if it and all its entries are there and finite, and if it has as many entries as most usable ones (of two such numbers the
    greater). Entries become floor(64 c) + 1,000,000, at most LARGEST in size. ``deviation`` is the sum of (n x - S)^2, exact; null where no long holds
    it. ``whitened`` is null in components without variance. Repeated rows and null ids count like others; further columns aren't returned. Tables without usable
    vectors give no row and no model.
    """
    rows, dims = _rows(table, id_col, vec_col)
    key = rows.schema["key"].dataType.simpleString()
    model = _fit(rows.select("vec"), dims, most)
    if model is None:
        empty = rows.where("false").select(F.col("key").alias(id_col), F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return empty, None
    n, sums, project = model.n, model.sums, model.projection(most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = n * _matrix(batch.column(1), dims) - sums
            white = apart / n @ np.nan_to_num(project)
            white[:, np.isnan(project).any(axis=0)] = np.nan
            exact, size = (apart * apart).sum(axis=1), (apart.astype(float) ** 2).sum(axis=1)
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.int64(), mask=size > (1 - 1e-9) * 2.0**63), lists], names=["key", "deviation", "whitened"])

    found = rows.mapInArrow(work, f"key {key}, deviation bigint, whitened array<double>")
    return found.withColumnRenamed("key", id_col), model
