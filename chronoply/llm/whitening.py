"""Whitening of embeddings by a covariance in two passes.

Entries become whole numbers, so the first pass adds up n and the sums exactly, in any order.
The second centres each vector by them, before anything is multiplied, and adds up outer
products a block at a time (a matrix product in NumPy). Each partition gives one matrix, and
treeAggregate merges them in rounds, so the driver meets a few. LAPACK's symmetric solver
gives the components there, which every task gets to project its rows on; their size is that
of the vectors, bounded by ``max_dim``. A third pass measures how white the result is.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Vectors that are multiplied at once.
BLOCK = 4096
#: Entries are taken up to this size; a larger one counts as it.
LARGEST = 2.0**50
#: int64 holds what stays below.
_WORD = 1 << 62


def _blocks(batches: Iterable[pa.RecordBatch], dim: int, scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches and their vectors as whole numbers."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            flat = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            real = np.clip(flat.astype(np.float64), -LARGEST, LARGEST)
            yield part, (np.floor(real * scale).astype(np.int64) + shift).reshape(-1, dim)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in int64 where that holds it, else as Python's numbers."""
    if n * _largest(x) < _WORD and max(map(abs, sums)) < _WORD:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None beyond 64 bits."""
    if y.dtype != object and _largest(y) ** 2 * y.shape[1] < _WORD:
        return (y * y).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (y.astype(object) ** 2).sum(axis=1).tolist()]


def _merged(vectors: DataFrame, of_block: Callable[[np.ndarray], tuple], blocks: Callable) -> tuple | None:
    """The sum over all blocks of what ``of_block`` gives (numbers, arrays); None without rows."""

    def plus(a: tuple | None, b: tuple | None) -> tuple | None:
        return (a or b) if a is None or b is None else tuple(x + y for x, y in zip(a, b, strict=True))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches):
            total = plus(total, of_block(x))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(total)], pa.binary())})

    return vectors.select("vector").mapInArrow(partial, "state binary").rdd.map(lambda r: pickle.loads(r.state)).treeAggregate(None, plus, plus)


def whiten(rows: DataFrame, *, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding", max_dim: int = 4096) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each
    vector and component.

    A null vector, or one with a null, NaN or infinite entry, is dropped, as is an empty one; of
    several lengths the commonest stays (the longer of two). Ties of eigenvalues give any basis of
    their space. A component without variance (below rounding) has nothing to divide by and is
    left out, so fewer than ``components`` come from short or flat vectors and none from equal
    ones. ``deviation`` is null where 64 bits don't hold it. Repeated rows and null ids are rows
    like others. Other columns are dropped, whatever their names. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    entry_ok = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull() & entry_ok & (F.size("vector") > 0))
    lengths = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = StructType([*vectors.select("vec_id").schema, *spark.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double").schema])
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths.dim
    if dim > max_dim:
        raise ValueError(f"vectors of {dim} entries; a matrix of more than {max_dim} columns isn't sent to tasks")
    vectors = vectors.where(F.size("vector") == dim)
    blocks = lambda batches: _blocks(batches, dim, scale, shift)

    def counted(x: np.ndarray) -> tuple[int, np.ndarray]:
        exact = x if len(x) * _largest(x) < _WORD else x.astype(object)
        return len(x), np.array(exact.sum(axis=0).tolist(), object)

    n, total = _merged(vectors, counted, blocks)
    sums = total.tolist()

    def outer(x: np.ndarray) -> tuple[np.ndarray]:
        y = (_centred(x, n, sums) / n).astype(np.float64)
        return (y.T @ y,)

    cov = _merged(vectors, outer, blocks)[0] / n
    values, axes = np.linalg.eigh(cov)
    values, axes, trace = values[::-1], axes[:, ::-1], float(np.trace(cov))
    made = min(components, int((values > dim * np.finfo(float).eps * max(values[0], 0)).sum()))
    if not made:
        return spark.createDataFrame([], schema)
    values, axes = values[:made], axes[:, :made]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(made)])  # one sign wherever it is run
    by = axes / np.sqrt(values)

    def white(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, sums) / n).astype(np.float64) @ by

    def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = white(x)
        return w.sum(axis=0), w.T @ w

    first, second = _merged(vectors, moments, blocks)
    error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(made)).max())
    shares = values / trace

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches):
            w = white(x)
            again = np.repeat(np.arange(len(x)), made)
            columns: list[Any] = [
                part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, made + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), n)),
                pa.array(_squares(_centred(x, n, sums)), pa.int64()).take(pa.array(again)), pa.array(w.ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(again), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.mapInArrow(projected, schema)
