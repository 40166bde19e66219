"""Sentence vectors: hashed terms, stored vectors, or a supplied batch encoder.

Every encoder adds a ``features`` column, NULL for a missing text: an array of doubles, or of many features a struct of
those that are not 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonescale.functions import tokens
from tonescale.operators.blocks import block_of, summed

FEATURES = "features"


@dataclass(frozen=True)
class HashedTerms:
    """Counts of whitespace tokens in ``size`` hash buckets, as log(1 + count) by default."""

    size: int = 256
    log: bool = True
    text: str = "text"

    def transform(self, df: DataFrame) -> DataFrame:
        terms, counts = "__terms", "__counts"
        # HashingTF takes no NULL.
        filled = df.withColumn(terms, F.coalesce(tokens(self.text), F.array().cast("array<string>")))
        hashed = HashingTF(numFeatures=self.size, inputCol=terms, outputCol=counts).transform(filled)
        dense = vector_to_array(counts)
        if self.log:
            dense = F.transform(dense, F.log1p)
        return hashed.withColumn(FEATURES, F.when(F.col(self.text).isNotNull(), dense)).drop(terms, counts)


@dataclass(frozen=True)
class StoredVectors:
    """Vectors computed before, joined by key. Rows without a vector keep a NULL."""

    table: DataFrame
    key: str = "id"
    vector: str = "embedding"

    def transform(self, df: DataFrame) -> DataFrame:
        vectors = self.table.select(self.key, F.col(self.vector).cast("array<double>").alias(FEATURES))
        return df.join(vectors, self.key, "left")


@dataclass(frozen=True)
class BatchEncoder:
    """A supplied model: ``make`` builds a function from numpy batches of texts to vectors, once per worker."""

    make: Callable
    inputs: tuple[str, ...] = ("text",)
    batch_size: int = 16

    def transform(self, df: DataFrame) -> DataFrame:
        encode = predict_batch_udf(self.make, return_type=T.ArrayType(T.DoubleType()), batch_size=self.batch_size)
        present = F.lit(True)
        for c in self.inputs:
            present = present & F.col(c).isNotNull()
        # The model takes no NULL: a row without a text is encoded as an empty one, and the vector dropped.
        filled = [F.coalesce(F.col(c), F.lit("")) for c in self.inputs]
        return df.withColumn(FEATURES, F.when(present, encode(*filled)))


@dataclass(frozen=True)
class SparseTerms:
    """The same counts for many buckets: a struct of the indices that occur and their values, as log(1 + count) by default."""

    size: int = 1 << 18
    log: bool = True
    text: str = "text"

    def transform(self, df: DataFrame) -> DataFrame:
        size, log = self.size, self.log

        @F.arrow_udf("indices array<int>, values array<double>")
        def counted(hashes: pa.Array) -> pa.Array:
            lengths = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(hashes), dtype=np.int64), lengths)
            bucket = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64) % size
            found, count = np.unique(row * size + bucket, return_counts=True)
            ends = np.searchsorted(found // size, np.arange(len(hashes) + 1)).astype(np.int32)
            values = np.log1p(count) if log else count.astype(float)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((found % size).astype(np.int32), values)]
            return pa.StructArray.from_arrays(lists, ["indices", "values"])

        words = F.coalesce(tokens(self.text), F.array().cast("array<string>"))
        made = counted(F.transform(words, lambda w: F.hash(w)))
        return df.withColumn(FEATURES, F.when(F.col(self.text).isNotNull(), made))


@dataclass(frozen=True)
class Weighted:
    """The features of another encoder, column by column weighted and scaled by the statistics of the rows it was fitted on.

    ``idf`` multiplies a column by ln((rows + 1) / (rows where it is not 0 + 1)), ``scale`` divides it by its standard deviation
    (a constant column becomes 0), ``center`` takes its mean away first, which fills sparse features and is refused there.
    Scaling undoes the weights, as the deviations grow with them. The statistics are kept with the encoder.
    """

    encoder: object
    rows: int
    documents: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    idf: bool = True
    scale: bool = False
    center: bool = False

    @property
    def size(self) -> int:
        return len(self.documents)

    def factors(self) -> np.ndarray:
        spread = np.array(self.spread)
        weight = np.log((self.rows + 1) / (np.array(self.documents) + 1)) if self.idf else np.ones(self.size)
        if not self.scale:
            return weight
        return np.where((weight > 0.0) & (spread > 0.0), 1.0 / np.where(spread > 0.0, spread, 1.0), 0.0)

    def transform(self, df: DataFrame) -> DataFrame:
        encoded = self.encoder.transform(df)
        kind = encoded.schema[FEATURES].dataType.simpleString()
        factor, size = self.factors(), self.size
        shift = np.array(self.mean) if self.center else np.zeros(size)
        sparse = kind.startswith("struct")
        if sparse and self.center:
            raise ValueError("sparse features cannot be centred")

        @F.arrow_udf(kind)
        def weighted(column: pa.Array) -> pa.Array:
            known = column.filter(column.is_valid())
            if sparse:
                indices, values = known.flatten()
                at = indices.flatten().to_numpy(zero_copy_only=False)
                made = pa.array(values.flatten().to_numpy(zero_copy_only=False) * factor[at])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(indices).to_numpy(zero_copy_only=False))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(at), made)]
                found = pa.StructArray.from_arrays(lists, ["indices", "values"])
            else:
                x = (block_of(known, size).x - shift) * factor
                ends = np.arange(0, x.size + 1, size, dtype=np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
            place = np.where(column.is_valid().to_numpy(zero_copy_only=False), 0, -1)
            place[place == 0] = np.arange(len(known))
            return found.take(pa.array(place, mask=place < 0))

        return encoded.withColumn(FEATURES, weighted(FEATURES))


def fit_weighting(df: DataFrame, encoder, idf: bool = True, scale: bool = False, center: bool = False) -> Weighted:
    """Document frequencies, means and standard deviations of all columns, in one aggregate over the rows that have features."""
    size = encoder.size
    rows = encoder.transform(df).filter(F.col(FEATURES).isNotNull()).select(FEATURES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, one = block_of(batch.column(0), size), np.ones((batch.num_rows, 1))
        parts = [x.mapped(f).back(one).ravel() for f in (lambda v: (v != 0.0).astype(float), lambda v: v, np.square)]
        return np.concatenate([[batch.num_rows], *parts])

    found = summed(rows, 1 + 3 * size, moments)
    n, (documents, total, square) = int(found[0]), found[1:].reshape(3, size)
    if n == 0:
        raise ValueError("no row with features to take statistics of")
    mean = total / n
    spread = np.sqrt(np.maximum(square - n * mean**2, 0.0) / max(n - 1, 1))
    # What is left of a constant column is rounding.
    spread[spread <= 1e-12 * np.sqrt(square / n)] = 0.0
    return Weighted(encoder, n, tuple(documents.tolist()), tuple(mean.tolist()), tuple(spread.tolist()), idf, scale, center)


def described(encoder) -> dict | None:
    """An encoder of this module that has no data or code of its own, as plain values; None for any other."""
    if isinstance(encoder, Weighted):
        inner = described(encoder.encoder)
        return inner and {f.name: getattr(encoder, f.name) for f in fields(encoder)} | {"kind": "Weighted", "encoder": inner}
    if isinstance(encoder, (HashedTerms, SparseTerms)):
        return {"kind": type(encoder).__name__} | asdict(encoder)
    return None


def from_description(values: dict):
    """The encoder that ``described`` told of."""
    values = dict(values)
    kind = values.pop("kind", "HashedTerms")
    if kind == "Weighted":
        lists = {k: tuple(values[k]) for k in ("documents", "mean", "spread")}
        return Weighted(**values | lists | {"encoder": from_description(values["encoder"])})
    return {"HashedTerms": HashedTerms, "SparseTerms": SparseTerms}[kind](**values)
