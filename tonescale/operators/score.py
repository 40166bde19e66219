"""Linear weights, their storage, and scoring of tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescale.functions import SCALE
from tonescale.operators.blocks import block_of
from tonescale.operators.features import FEATURES, described, from_description

_TABLE = "dim string, position int, intercept double, weights array<double>, encoder string"


@dataclass(frozen=True)
class LinearWeights:
    """One row of weights and one intercept per dimension, on targets divided by the scale."""

    dims: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray
    encoder: object | None = None

    @property
    def size(self) -> int:
        return self.weights.shape[1]

    def to_table(self, spark: SparkSession) -> DataFrame:
        described_as = described(self.encoder)
        spec = json.dumps(described_as) if described_as else None
        rows = [
            # The encoder is told once: its statistics may be as long as the weights.
            (dim, at, float(self.intercepts[at]), [float(w) for w in self.weights[at]], None if at else spec)
            for at, dim in enumerate(self.dims)
        ]
        return spark.createDataFrame(rows, _TABLE)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def from_table(cls, table: DataFrame, encoder: object | None = None) -> LinearWeights:
        """Weights from a table with one row per dimension; an encoder that was not stored has to be given."""
        rows = table.orderBy("position").collect()
        if encoder is None and rows and rows[0]["encoder"]:
            encoder = from_description(json.loads(rows[0]["encoder"]))
        return cls(
            tuple(r["dim"] for r in rows),
            np.array([r["weights"] for r in rows], dtype=float),
            np.array([r["intercept"] for r in rows], dtype=float),
            encoder,
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: object | None = None) -> LinearWeights:
        return cls.from_table(spark.read.schema(_TABLE).parquet(path), encoder)


def refuse_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("there is nothing to score")
    return df


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column without NULLs as a matrix."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return flat.reshape(-1, size)


def score_features(df: DataFrame, model: LinearWeights, suffix: str = "_pred", column: str = FEATURES) -> DataFrame:
    """Add ``{dim}_pred`` on the annotation scale, not clipped; a NULL vector gives NULL.

    Only the vectors travel to Python, in Arrow batches, and all dimensions come
    back from one matrix product; the other columns stay in the JVM.
    """
    dims, weights, intercepts, size = model.dims, model.weights, model.intercepts, model.size
    names = [f"{d}{suffix}" for d in dims]

    @F.arrow_udf(", ".join(f"`{n}` double" for n in names))
    def predict(vectors: pa.Array) -> pa.Array:
        known = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        out = np.zeros((len(vectors), len(names)))
        out[known] = (block_of(vectors.filter(vectors.is_valid()), size).times(weights) + intercepts) * SCALE
        return pa.StructArray.from_arrays([pa.array(out[:, k], mask=~known) for k in range(len(names))], names)

    return df.withColumn("__scores", predict(column)).select("*", "__scores.*").drop("__scores")


def score(df: DataFrame, model: LinearWeights, encoder=None, keep_features: bool = False) -> DataFrame:
    """Encode and score a table of texts, keeping its rows and columns."""
    encoder = encoder or model.encoder
    if encoder is None:
        raise ValueError("the model was stored without its encoder; pass one")
    scored = score_features(encoder.transform(df), model)
    return scored if keep_features else scored.drop(FEATURES)


def as_weights(models: Sequence[tuple[str, object]], encoder: object | None = None) -> LinearWeights:
    """One weights table from separately fitted ``LinearRegressionModel``s."""
    return LinearWeights(
        tuple(dim for dim, _ in models),
        np.array([m.coefficients.toArray() for _, m in models]),
        np.array([m.intercept for _, m in models]),
        encoder,
    )
