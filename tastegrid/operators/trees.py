"""Small matrices reduced over all rows of a table in a tree of tasks: sums, and the R factors of tall QRs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Matrices that one task of a level takes.
FAN = 32
SCHEMA = "part long, kind int, cols int, data binary"

Reducer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def stacked_qr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The R factor of both on top of each other: orthogonal changes only, so no condition number is squared."""
    return np.linalg.qr(np.vstack([a, b]), mode="r")


def matrix(batch, name: str) -> np.ndarray:
    """A column of equally long arrays, or of packed rows, as the rows of a matrix."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty((0, 0))
    if pa.types.is_binary(col.type):
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
        flat = np.frombuffer(col.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.float64)
    else:
        flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of their bytes, which tables write and read much faster than arrays."""
    rows, width = x.shape
    ends = np.arange(rows + 1, dtype=np.int32) * (8 * width)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, np.float64).tobytes())])


def arrays(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of arrays."""
    rows, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel()))


def reduced(df: DataFrame, of: Callable[[pa.RecordBatch], list[np.ndarray]], by: list[Reducer]) -> list[np.ndarray] | None:
    """One matrix per reducer: ``of`` gives them for a batch of rows, and tasks of ``FAN`` combine them level by
    level, so that the driver receives one row per matrix however many tasks there are. Parts are combined in
    the order of partitions, so that a task that runs again changes nothing. None without rows."""
    def write(part, found):
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()),
             pa.array([x.shape[1] for x in found], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for x in found], pa.binary())],
            names=["part", "kind", "cols", "data"])

    def partial(batches):
        found = None
        for b in batches:
            if b.num_rows:
                new = of(b)
                # A first part goes through its reducer too: a tall part shrinks to its R factor.
                found = [f(x[:0] if f is stacked_qr else np.zeros_like(x), x) for f, x in zip(by, new)] if found is None \
                    else [f(x, y) for f, x, y in zip(by, found, new)]
        if found is not None:
            yield write(TaskContext.get().partitionId(), found)

    def combined(table):
        found: dict[int, np.ndarray] = {}
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "cols", "data"))), key=lambda r: r[:2])
        for kind, _, cols, data in rows:
            x = np.frombuffer(data).reshape(-1, cols)
            found[kind] = by[kind](found[kind], x) if kind in found else x
        return pa.Table.from_batches([write(rows[0][1] // FAN, [found[k] for k in range(len(by))])])
    parts = df.rdd.getNumPartitions()
    out = df.mapInArrow(partial, SCHEMA)
    while True:
        out = out.groupBy(F.floor(F.col("part") / FAN).alias("level")).applyInArrow(combined, SCHEMA)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    rows = sorted(out.collect(), key=lambda r: r.kind)
    return [np.frombuffer(r.data).reshape(-1, r.cols) for r in rows] or None
