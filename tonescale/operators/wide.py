"""Least-squares fits on any number of features: conjugate gradients, of which each step is one pass over the rows.

No matrix of features by features is ever formed, in a task or on the driver. A pass sends k weight vectors to the
tasks and brings back k vectors of the same length, summed cell by cell before they reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS, is_present, scale_target
from tonescale.operators.blocks import block_of, summed
from tonescale.operators.features import FEATURES
from tonescale.operators.score import LinearWeights
from tonescale.session import materialize, scratch

#: A dimension's residual is small enough at this share of its right-hand side.
TOLERANCE = 1e-10


def _targets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets (rows, k), 0 where there is none, and where there is one."""
    y = np.asarray(batch.column("y").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, k)
    known = ~np.isnan(y)
    return np.where(known, y, 0.0), known.astype(float)


def _solve(rows: DataFrame, size: int, dims: Sequence[str], reg: float, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    k = len(dims)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = block_of(batch.column("features"), size)
        y, known = _targets(batch, k)
        wide = [x.back(known), x.mapped(np.square).back(known), x.back(y)]
        return np.concatenate([known.sum(0), y.sum(0), (y * y).sum(0), *(m.ravel() for m in wide)])

    found = summed(rows, 3 * k + 3 * k * size, moments)
    n, sum_y, sum_yy = found[: 3 * k].reshape(3, k)
    for d, rows_of in zip(dims, n):
        if rows_of == 0:
            raise ValueError(f"no complete row of dimension {d} to fit on")
    sum_x, sum_xx, sum_xy = found[3 * k :].reshape(3, k, size) / n[None, :, None]
    mean_y = sum_y / n
    spread = np.sqrt(np.maximum(sum_yy / n - mean_y**2, 0.0))
    constant = spread <= 1e-15 * np.maximum(np.abs(mean_y), 1.0)
    penalty = reg / np.where(constant, 1.0, spread)
    goal = sum_xy - mean_y[:, None] * sum_x
    goal[constant] = 0.0
    diagonal = np.maximum(sum_xx - sum_x**2, 0.0) + penalty[:, None]
    diagonal = np.where(diagonal > 0.0, diagonal, 1.0)

    def applied(v: np.ndarray) -> np.ndarray:
        """The centred products of all features, times ``v``, and the penalty: one pass."""

        def product(batch: pa.RecordBatch) -> np.ndarray:
            x = block_of(batch.column("features"), size)
            _, known = _targets(batch, k)
            return x.back(x.times(v) * known).ravel()

        total = summed(rows, k * size, product).reshape(k, size) / n[:, None]
        return total - sum_x * (sum_x * v).sum(1)[:, None] + penalty[:, None] * v

    w, residual = np.zeros((k, size)), goal.copy()
    ahead = residual / diagonal
    direction, square = ahead.copy(), (residual * ahead).sum(1)
    limit = tolerance * np.linalg.norm(goal, axis=1)
    for _ in range(most):
        going = np.linalg.norm(residual, axis=1) > limit
        if not going.any():
            break
        product = applied(np.where(going[:, None], direction, 0.0))
        curve = (direction * product).sum(1)
        going &= curve > 0.0
        if not going.any():
            break
        step = np.where(going, square / np.where(going, curve, 1.0), 0.0)[:, None]
        w, residual = w + step * direction, residual - step * product
        ahead = residual / diagonal
        before, square = square, (residual * ahead).sum(1)
        direction = ahead + (square / np.where(before > 0.0, before, 1.0))[:, None] * direction
    return w, mean_y - (w * sum_x).sum(1)


def _fitted(rows: DataFrame, size: int, dims: Sequence[str], reg: float, tolerance: float, most: int | None, encoder) -> LinearWeights:
    with scratch(rows.sparkSession):
        stored = materialize(rows, "wide")
        w, b = _solve(stored, size, dims, reg, tolerance, most or 2 * size)
    return LinearWeights(tuple(dims), w, b, encoder)


def fit_wide(
    df: DataFrame, size: int, dims: Sequence[str] = DIMENSIONS, reg: float = 0.01, tolerance: float = TOLERANCE, most: int | None = None,
    encoder=None, column: str = FEATURES,
) -> LinearWeights:
    """All targets of the complete rows, as ``fit_multi`` fits them, for features in any number.

    ``column`` holds arrays, or structs of indices and values. The features are stored once; then each step of all dimensions
    together is one pass, until every residual is below ``tolerance`` times its right-hand side or ``most`` steps were made
    (twice the features unless given; steps are preconditioned by the columns' variances, so few are needed).
    A constant target, and no target at all in a direction, give zero weights.
    """
    complete = F.col(column).isNotNull()
    for d in dims:
        complete = complete & is_present(F.col(d).cast("double"))
    rows = df.filter(complete).select(F.col(column).alias("features"), F.array(*[scale_target(d) for d in dims]).alias("y"))
    return _fitted(rows, size, dims, reg, tolerance, most, encoder)


def fit_wide_long(
    df: DataFrame, size: int, dims: Sequence[str] = DIMENSIONS, reg: float = 0.01, tolerance: float = TOLERANCE, most: int | None = None,
    encoder=None, column: str = FEATURES,
) -> LinearWeights:
    """One separate fit per dimension of a long table ``(dim, value, features)``, each on its own rows, as ``fit_long`` fits them."""
    known = F.col("dim").isin(*dims) & F.col(column).isNotNull() & is_present(F.col("value").cast("double"))
    none = F.lit(float("nan"))
    y = F.array(*[F.when(F.col("dim") == d, scale_target("value")).otherwise(none) for d in dims])
    return _fitted(df.filter(known).select(F.col(column).alias("features"), y.alias("y")), size, dims, reg, tolerance, most, encoder)
