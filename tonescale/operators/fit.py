"""Fitting linear heads on fixed features: per target, jointly, or epoch by epoch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS, is_present, scale_target
from tonescale.operators.features import FEATURES
from tonescale.operators.position import batch_of, order_digest, with_position
from tonescale.operators.score import LinearWeights, matrix_of
from tonescale.session import materialize, scratch

# A task holds a tile of the product matrix of at most this many rows and columns.
TILE = 1024
# Parts of the data that a mini-batch is made of.
FOLDS_PER_BATCH = 8


def _usable(df: DataFrame, targets: Sequence[str], column: str = FEATURES) -> DataFrame:
    keep = F.col(column).isNotNull()
    for t in targets:
        keep = keep & is_present(F.col(t).cast("double"))
    return df.filter(keep)


def cross_products(df: DataFrame, size: int, targets: Sequence[str] = (), column: str = FEATURES, tile: int = TILE) -> DataFrame:
    """Upper triangle ``(i, j, value)`` of ZᵀZ for the rows Z = (1, features, targets).

    Index 0 is the constant, 1..size the features, then the targets. Each task multiplies
    its Arrow batches and sends one partial matrix, and the partial matrices are added up per
    cell. A matrix wider than ``tile`` is computed tile by tile, each in a pass of its own, so a
    task's memory does not grow with the number of features.
    """
    targets = list(targets)
    width = 1 + size + len(targets)
    rows = _usable(df, targets, column).select(
        F.col(column).cast("array<double>").alias(FEATURES), *[F.col(t).cast("double").alias(t) for t in targets]
    )
    cuts = [*range(0, width, tile), width]
    spans = list(zip(cuts, cuts[1:]))

    def products(first: tuple[int, int], second: tuple[int, int]):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((first[1] - first[0], second[1] - second[0]))
            seen = False
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                seen = True
                z = np.ones((batch.num_rows, width))
                z[:, 1 : 1 + size] = matrix_of(batch.column(0), size)
                for k in range(len(targets)):
                    z[:, 1 + size + k] = batch.column(1 + k).to_numpy(zero_copy_only=False)
                total += z[:, slice(*first)].T @ z[:, slice(*second)]
            if seen:
                i, j = (np.triu_indices(len(total)) if first == second else np.indices(total.shape).reshape(2, -1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[0] + i, pa.int32()), pa.array(second[0] + j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"]
                )

        return partial

    tiles = [rows.mapInArrow(products(a, b), "i int, j int, value double") for n, a in enumerate(spans) for b in spans[n:]]
    partials = tiles[0]
    for more in tiles[1:]:
        partials = partials.unionByName(more)
    return partials.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _solve(cells: pd.DataFrame, size: int, targets: int, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of all targets from the cells of their cross products."""
    width = 1 + size + targets
    z = np.zeros((width, width))
    z[cells["i"], cells["j"]] = cells["value"]
    z = np.triu(z) + np.triu(z, 1).T
    n = z[0, 0]
    if n == 0:
        raise ValueError("no complete row to fit on")
    mean = z[0] / n
    centred = z / n - np.outer(mean, mean)
    x, out = slice(1, 1 + size), range(1 + size, width)
    weights = []
    for k in out:
        spread = np.sqrt(max(centred[k, k], 0.0))
        if spread == 0.0:
            weights.append(np.zeros(size))
            continue
        penalised = centred[x, x] + (reg / spread) * np.eye(size)
        weights.append(np.linalg.lstsq(penalised, centred[x, k], rcond=None)[0])
    w = np.array(weights)
    return w, mean[1 + size :] - w @ mean[x]


def fit_multi(
    df: DataFrame, size: int, dims: Sequence[str] = DIMENSIONS, reg: float = 0.01, encoder=None
) -> LinearWeights:
    """All targets in one pass: least squares with an L2 penalty, from the cross products.

    The driver only solves the (features x features) system. Targets are divided by
    the scale. The penalty is divided by each target's standard deviation and leaves
    the intercept free, as ``LinearRegression`` does.
    """
    scaled = df.select(FEATURES, *[scale_target(d).alias(d) for d in dims])
    weights, intercepts = _solve(cross_products(scaled, size, dims).toPandas(), size, len(dims), reg)
    return LinearWeights(tuple(dims), weights, intercepts, encoder)


def fit_single(df: DataFrame, target: str, reg: float = 0.01, solver: str = "normal") -> LinearRegressionModel:
    """One target, one Spark ML model. It is stored with ``model.write()``."""
    rows = _usable(df, [target]).select(
        array_to_vector(F.col(FEATURES).cast("array<double>")).alias(FEATURES), scale_target(target).alias("label")
    )
    fitter = LinearRegression(
        featuresCol=FEATURES, labelCol="label", regParam=reg, elasticNetParam=0.0, standardization=False, solver=solver
    )
    return fitter.fit(rows)


def fit_long(df: DataFrame, size: int, dims: Sequence[str] = DIMENSIONS, reg: float = 0.01, encoder=None) -> LinearWeights:
    """One separate fit per dimension of a long table ``(dim, value, features)``, all in one pass.

    Every dimension is fitted on its own rows, which need not be the same, as ``fit_single`` would.
    """
    rows = df.filter(F.col("dim").isin(*dims)).select(FEATURES, "dim", scale_target("value").alias("value"))
    rows = _usable(rows, ["value"]).select(F.col(FEATURES).cast("array<double>").alias(FEATURES), "dim", "value")
    width = 2 + size
    names = list(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), width, width))
        for batch in batches:
            if batch.num_rows:
                z = np.ones((batch.num_rows, width))
                z[:, 1 : 1 + size] = matrix_of(batch.column(0), size)
                z[:, 1 + size] = batch.column(2).to_numpy(zero_copy_only=False)
                of = np.array(batch.column(1).to_pylist())
                for k, d in enumerate(names):
                    own = z[of == d]
                    total[k] += own.T @ own
        i, j = np.triu_indices(width)
        for k in range(len(names)):
            if total[k, 0, 0]:
                cells = [pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[k, i, j])]
                yield pa.RecordBatch.from_arrays(cells, ["k", "i", "j", "value"])

    cells = rows.mapInArrow(partial, "k int, i int, j int, value double").groupBy("k", "i", "j").agg(F.sum("value").alias("value")).toPandas()
    weights, intercepts = [], []
    for k, d in enumerate(names):
        own = cells[cells["k"] == k]
        if own.empty:
            raise ValueError(f"no complete row of dimension {d} to fit on")
        w, b = _solve(own, size, 1, reg)
        weights.append(w[0])
        intercepts.append(b[0])
    return LinearWeights(tuple(dims), np.array(weights), np.array(intercepts), encoder)


@dataclass(frozen=True)
class EpochFit:
    """Weights of the best epoch and the loss log ``(run, epoch, train_loss, val_loss)``."""

    model: LinearWeights
    losses: DataFrame


class _Adam:
    def __init__(self, shape: tuple[int, int], rate: float):
        self.rate, self.step = rate, 0
        self.first, self.second = np.zeros(shape), np.zeros(shape)

    def update(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        first = self.first / (1 - 0.9**self.step)
        second = self.second / (1 - 0.999**self.step)
        return weights - self.rate * first / (np.sqrt(second) + 1e-8)


def _residuals(batch: pa.RecordBatch, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """Standardised rows with a leading one, and prediction minus target per dimension."""
    names = batch.schema.names
    x = np.ones((batch.num_rows, 1 + len(mean)))
    x[:, 1:] = (matrix_of(batch.column(names.index(FEATURES)), len(mean)) - mean) / spread
    y = matrix_of(batch.column(names.index("y")), weights.shape[0])
    return x, x @ weights.T - y


def _losses(error: np.ndarray) -> np.ndarray:
    size = np.abs(error)
    return np.where(size < 1.0, 0.5 * size * size, size - 0.5)


def _gradient(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """Row count, loss sum and gradient sum of every dimension, in one aggregate."""
    k, width = weights.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per dimension: count, loss, then the gradient.
        total = np.zeros((k, 2 + width))
        for batch in batches:
            if batch.num_rows:
                x, error = _residuals(batch, weights, mean, spread)
                total[:, 0] += len(x)
                total[:, 1] += _losses(error).sum(axis=0)
                total[:, 2:] += np.clip(error, -1.0, 1.0).T @ x
        if total[0, 0]:
            cell = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    partials = rows.select(FEATURES, "y").mapInArrow(partial, "cell int, value double")
    cells = partials.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(k * (2 + width))
    total[cells["cell"]] = cells["value"]
    total = total.reshape(k, 2 + width)
    return total[0, 0], total[:, 1], total[:, 2:]


def _validation_loss(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Per dimension the plain mean of batch means over the validation batches."""
    k = weights.shape[0]
    names = [f"loss_{d}" for d in range(k)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, error = _residuals(batch, weights, mean, spread)
            ids, at = np.unique(batch.column(batch.schema.names.index("batch_id")).to_numpy(), return_inverse=True)
            loss = _losses(error)
            sums = [np.bincount(at, loss[:, d], len(ids)) for d in range(k)]
            count = np.bincount(at, minlength=len(ids)).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, count, *sums)], ["batch_id", "n", *names])

    schema = "batch_id long, n double, " + ", ".join(f"{c} double" for c in names)
    summed = rows.select("batch_id", FEATURES, "y").mapInArrow(partial, schema).groupBy("batch_id")
    means = summed.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    return np.array(means.agg(*[F.avg(F.col(c) / F.col("n")) for c in names]).first(), dtype=float)


def _in_folds(rows: DataFrame, key: str, folds: int) -> DataFrame:
    """Store the rows by hash fold, so that a step reads its own rows and no others; fold -1 is for validation.

    The rebalancing shuffle gives files of even size however the folds come out; a single fold needs none.
    """
    digest = F.substring(order_digest(key, 0), 1, 8)
    fold = F.when(F.col("split") == "val", -1).otherwise(F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(folds)))
    placed = rows.withColumn("fold", fold.cast("int"))
    return materialize(placed.hint("rebalance", "fold") if folds > 1 else placed, "fit", ["fold"])


def _batches(folds: int, per_epoch: int, seed: int, epoch: int) -> list[list[int]]:
    """The folds of each mini-batch, in the random order of one epoch."""
    order = sorted(range(folds), key=lambda f: hashlib.md5(f"{seed}-{epoch}-{f}".encode()).hexdigest())
    return [order[at::per_epoch] for at in range(per_epoch)]


def fit_epochs(
    df: DataFrame,
    size: int,
    dims: Sequence[str] = DIMENSIONS,
    epochs: int = 8,
    batches_per_epoch: int = 8,
    rate: float = 3e-4,
    patience: int = 3,
    val_batch: int = 16,
    seed: int = 42,
    joint: bool = True,
    key: str = "id",
    encoder=None,
    noise: float = 1e-9,
) -> EpochFit:
    """Smooth-L1 fit with a train and a validation loss per epoch, early stopping, best epoch kept.

    ``df`` has ``key``, ``split`` (train/val), the features and the targets. It is
    written once, reduced to what the steps read and cut into hash folds. Each
    mini-batch takes other folds in every epoch and is one aggregate over these alone,
    so an epoch reads the training rows once: the driver sends the weights and gets
    back one sum per weight. ``joint`` stops all dimensions together on their mean
    loss; otherwise each one is a run of its own and stops and keeps its best epoch by
    itself, still in the same passes. With one batch an epoch the intercepts start at
    their optimum: of their gradient, what is below ``noise`` times the largest one of the
    dimension is rounding, which Adam would scale up, and counts as 0.
    """
    with scratch(df.sparkSession):
        return _fit_epochs(df, size, dims, epochs, batches_per_epoch, rate, patience, val_batch, seed, joint, key, encoder, noise)


def _fit_epochs(df, size, dims, epochs, batches_per_epoch, rate, patience, val_batch, seed, joint, key, encoder, noise) -> EpochFit:
    k = len(dims)
    slim = _usable(df, dims).select(
        key,
        "split",
        F.col(FEATURES).cast("array<double>").alias(FEATURES),
        F.array(*[scale_target(d) for d in dims]).alias("y"),
    )
    folds = FOLDS_PER_BATCH * batches_per_epoch if batches_per_epoch > 1 else 1
    stored = _in_folds(slim.filter(F.col("split").isin("train", "val")), key, folds).drop("split")
    train = stored.filter(F.col("fold") >= 0)
    if train.isEmpty():
        raise ValueError("no complete training row")
    val = with_position(stored.filter(F.col("fold") == -1).drop("fold"), [key])
    val = val.withColumn("batch_id", batch_of("pos", val_batch))
    stats = train.agg(
        Summarizer.metrics("mean", "std").summary(array_to_vector(FEATURES)).alias("x"),
        F.array(*[F.avg(F.get("y", F.lit(d))) for d in range(k)]).alias("y"),
    ).first()
    mean, spread = stats["x"]["mean"].toArray(), stats["x"]["std"].toArray()
    spread = np.where(spread > 0.0, spread, 1.0)
    weights = np.zeros((k, 1 + size))
    weights[:, 0] = stats["y"]
    best, best_loss = weights.copy(), np.full(k, np.inf)
    waited = np.zeros(k, dtype=int)
    active = np.ones(k, dtype=bool)
    adam, log = _Adam(weights.shape, rate), []
    for epoch in range(1, epochs + 1):
        seen = []
        for chosen in _batches(folds, batches_per_epoch, seed, epoch):
            n, loss, gradient = _gradient(train.filter(F.col("fold").isin(chosen)), weights, mean, spread)
            if n == 0:
                continue
            seen.append(loss / n)
            gradient = gradient / (n * k if joint else n)
            if batches_per_epoch == 1:
                at_rest = np.abs(gradient[:, 0]) < noise * np.abs(gradient).max(axis=1)
                gradient[at_rest, 0] = 0.0
            weights = np.where(active[:, None], adam.update(weights, gradient), weights)
        train_loss = np.mean(seen, axis=0)
        val_loss = _validation_loss(val, weights, mean, spread)
        if joint:
            log.append(("joint", epoch, float(train_loss.mean()), float(val_loss.mean())))
            val_loss = np.full(k, val_loss.mean())
        else:
            log += [(d, epoch, float(train_loss[i]), float(val_loss[i])) for i, d in enumerate(dims) if active[i]]
        improved = active & (val_loss < best_loss)
        best[improved], best_loss[improved] = weights[improved], val_loss[improved]
        waited = np.where(improved, 0, waited + 1)
        active &= waited < patience
        if not active.any():
            break
    w = best[:, 1:] / spread
    model = LinearWeights(tuple(dims), w, best[:, 0] - w @ mean, encoder)
    losses = df.sparkSession.createDataFrame(log, "run string, epoch int, train_loss double, val_loss double")
    return EpochFit(model, losses)
