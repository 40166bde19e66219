"""Fits with one step for every few rows: workers go through their own rows, and their weights are averaged after each epoch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS, scale_target
from tonescale.operators.features import FEATURES
from tonescale.operators.fit import EpochFit, _losses, _usable, _validation_loss
from tonescale.operators.position import batch_of, order_digest, with_position
from tonescale.operators.score import LinearWeights, matrix_of
from tonescale.session import bucketed, materialize, scratch

SHARD = "shard"


class _Walk:
    """Adam over consecutive batches of rows, from a state that all workers begin an epoch with."""

    def __init__(self, state: np.ndarray, step: int, active: np.ndarray, rate: float, batch: int, joint: bool) -> None:
        self.weights, self.first, self.second = state.copy()
        self.step, self.rate, self.batch = step, rate, batch
        self.active = active[:, None]
        self.share = len(active) if joint else 1
        self.rows, self.batches, self.loss = 0, 0, np.zeros(len(active))

    def take(self, x: np.ndarray, y: np.ndarray) -> None:
        """One step for one batch."""
        error = x @ self.weights.T - y
        self.rows += len(x)
        self.batches += 1
        self.loss += _losses(error).mean(axis=0)
        gradient = np.clip(error, -1.0, 1.0).T @ x / (len(x) * self.share)
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        down = self.first / (1 - 0.9**self.step) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        self.weights = np.where(self.active, self.weights - self.rate * down, self.weights)

    def through(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Steps for all rows in their order; only the last batch may be shorter."""
        x = y = None
        for more_x, more_y in blocks:
            x = more_x if x is None else np.concatenate([x, more_x])
            y = more_y if y is None else np.concatenate([y, more_y])
            whole = len(x) - len(x) % self.batch
            for at in range(0, whole, self.batch):
                self.take(x[at : at + self.batch], y[at : at + self.batch])
            x, y = x[whole:], y[whole:]
        if x is not None and len(x):
            self.take(x, y)

    def cells(self) -> np.ndarray:
        """Rows, batches and losses, then the state weighted by the rows."""
        state = np.stack([self.weights, self.first, self.second]) * self.rows
        return np.concatenate([[self.rows, self.batches], self.loss, state.ravel()])


def epoch_of_steps(
    train: DataFrame, state: np.ndarray, step: int, active: np.ndarray, mean: np.ndarray, spread: np.ndarray,
    epoch: int, key: str = "id", batch: int = 16, rate: float = 2e-5, joint: bool = True, seed: int = 42,
) -> tuple[np.ndarray, int, np.ndarray]:
    """``(state, step, losses)`` after one epoch, in one Spark job.

    ``train`` has ``shard``, the key, the features and ``y``. Each shard is a worker: its rows come in the random order
    of the epoch, in Arrow batches, and every ``batch`` of them is a step. What comes back is summed cell by cell
    before it reaches the driver: the weights and moments, weighted by the rows of their shard. ``losses`` are the
    means of all batch losses.
    """
    k, width = state.shape[1:]
    size = width - 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for rows in batches:
                if rows.num_rows:
                    x = np.ones((rows.num_rows, width))
                    x[:, 1:] = (matrix_of(rows.column("features"), size) - mean) / spread
                    yield x, matrix_of(rows.column("y"), k)

        worker = _Walk(state, step, active, rate, batch, joint)
        worker.through(blocks())
        cells = worker.cells()
        columns = [pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells), pa.array(np.full(len(cells), worker.step), pa.int64())]
        yield pa.record_batch(columns, ["cell", "value", "step"])

    # The order within a shard is that of the sort; grouping needs no more than the shards together, which the buckets give.
    placed = train.sortWithinPartitions(SHARD, order_digest(key, seed, epoch), key)
    rows = placed.select(SHARD, F.col(FEATURES).alias("features"), "y")
    partials = rows.groupBy(SHARD).applyInArrow(walk, "cell int, value double, step long")
    found = partials.groupBy("cell").agg(F.sum("value").alias("value"), F.max("step").alias("step")).toArrow()
    cells = np.zeros(2 + k + state.size)
    cells[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    rows_seen, batches_seen, loss = cells[0], cells[1], cells[2 : 2 + k]
    after = cells[2 + k :].reshape(state.shape) / rows_seen
    return after, max(found.column("step").to_pylist()), loss / batches_seen


def in_shards(rows: DataFrame, workers: int, key: str = "id", seed: int = 42) -> DataFrame:
    """The rows in as many random shards, each stored in one bucket: every epoch reads them where they are, without a shuffle."""
    digest = F.conv(F.substring(order_digest(key, seed), 1, 8), 16, 10).cast("long")
    return bucketed(rows.withColumn(SHARD, F.pmod(digest, F.lit(workers)).cast("int")), "shards", workers, SHARD)


def fit_minibatches(
    df: DataFrame,
    size: int,
    dims: Sequence[str] = DIMENSIONS,
    epochs: int = 8,
    batch: int = 16,
    rate: float = 2e-5,
    patience: int = 3,
    workers: int = 8,
    val_batch: int = 16,
    seed: int = 42,
    joint: bool = True,
    key: str = "id",
    encoder=None,
) -> EpochFit:
    """Smooth-L1 fit by Adam with one step per ``batch`` rows, a new random order each epoch, early stopping, best epoch kept.

    ``df`` has a unique ``key``, ``split`` (train/val), the features and the targets. With one worker this is the plain
    loop over all training rows. Several workers step through their own shards side by side and begin each epoch
    with the averages of their weights and moments, weighted by rows; steps count on from the longest shard. An
    epoch is one Spark job for the steps and one for the validation loss; it reads stored rows and sorts each shard by
    itself. The result depends on the keys, the seed and the number of workers, not on where rows lie.
    """
    with scratch(df.sparkSession):
        k = len(dims)
        slim = _usable(df, dims).select(
            key, "split", F.col(FEATURES).cast("array<double>").alias(FEATURES), F.array(*[scale_target(d) for d in dims]).alias("y")
        )
        stored = materialize(slim.filter(F.col("split").isin("train", "val")), "fit", ["split"])
        train = in_shards(stored.filter(F.col("split") == "train").drop("split"), workers, key, seed)
        if train.isEmpty():
            raise ValueError("no complete training row")
        val = with_position(stored.filter(F.col("split") == "val").drop("split"), [key])
        val = val.withColumn("batch_id", batch_of("pos", val_batch))
        stats = train.agg(
            Summarizer.metrics("mean", "std").summary(array_to_vector(FEATURES)).alias("x"),
            F.array(*[F.avg(F.get("y", F.lit(d))) for d in range(k)]).alias("y"),
        ).first()
        mean, spread = stats["x"]["mean"].toArray(), stats["x"]["std"].toArray()
        spread = np.where(spread > 0.0, spread, 1.0)
        state = np.zeros((3, k, 1 + size))
        state[0, :, 0] = stats["y"]
        step, best, best_loss = 0, state[0].copy(), np.full(k, np.inf)
        waited, active, log = np.zeros(k, int), np.ones(k, bool), []
        for epoch in range(1, epochs + 1):
            state, step, loss = epoch_of_steps(train, state, step, active, mean, spread, epoch, key, batch, rate, joint, seed)
            val_loss = _validation_loss(val, state[0], mean, spread)
            if joint:
                log.append(("joint", epoch, float(loss.mean()), float(val_loss.mean())))
                val_loss = np.full(k, val_loss.mean())
            else:
                log += [(d, epoch, float(loss[i]), float(val_loss[i])) for i, d in enumerate(dims) if active[i]]
            improved = active & (val_loss < best_loss)
            best[improved], best_loss[improved] = state[0][improved], val_loss[improved]
            waited = np.where(improved, 0, waited + 1)
            active &= waited < patience
            if not active.any():
                break
        w = best[:, 1:] / spread
        model = LinearWeights(tuple(dims), w, best[:, 0] - w @ mean, encoder)
        losses = df.sparkSession.createDataFrame(log, "run string, epoch int, train_loss double, val_loss double")
        return EpochFit(model, losses)
