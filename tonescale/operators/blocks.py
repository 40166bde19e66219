"""Blocks of feature rows from Arrow columns, dense (lists of numbers) or sparse (structs of indices and values)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dense:
    """Rows as a matrix."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x

    def times(self, w: np.ndarray) -> np.ndarray:
        """Products (rows, k) with k weight vectors."""
        return self.x @ w.T

    def back(self, r: np.ndarray) -> np.ndarray:
        """Sums (k, size) of the rows, each times its numbers ``r`` (rows, k)."""
        return r.T @ self.x

    def mapped(self, f) -> Dense:
        """The block with another value in each place; zeros stay zeros."""
        return Dense(f(self.x))


class Sparse:
    """Rows as runs of (index, value); an index that repeats within a row counts with the sum of its values."""

    def __init__(self, lengths: np.ndarray, indices: np.ndarray, values: np.ndarray, size: int) -> None:
        self.n, self.size = len(lengths), size
        self.rows = np.repeat(np.arange(self.n), lengths)
        self.indices, self.values = indices, values

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows, self.values * one[self.indices], self.n) for one in w], axis=1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.indices, self.values * one[self.rows], self.size) for one in r.T])

    def mapped(self, f) -> Sparse:
        made = Sparse(np.zeros(0, int), self.indices, f(self.values), self.size)
        made.n, made.rows = self.n, self.rows
        return made


def block_of(column: pa.Array, size: int) -> Dense | Sparse:
    """The block of a column without NULLs."""
    if not pa.types.is_struct(column.type):
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
        return Dense(flat.reshape(-1, size))
    indices, values = column.flatten()
    lengths = pc.list_value_length(indices).to_numpy(zero_copy_only=False)
    at = indices.flatten().to_numpy(zero_copy_only=False)
    if len(at) and (at.min() < 0 or at.max() >= size):
        raise ValueError(f"a feature index lies outside 0..{size - 1}")
    return Sparse(lengths, at, np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=float), size)


def summed(rows: DataFrame, count: int, make) -> np.ndarray:
    """``count`` sums over all rows: ``make`` turns an Arrow batch into them. Each task sends the cells that are not 0."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells, pa.int64()), pa.array(total[cells])], ["cell", "value"])

    found = rows.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    cells = np.zeros(count)
    cells[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return cells
