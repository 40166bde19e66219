"""Encoders and fits as Spark ML stages: they go into a ``Pipeline`` and are stored and loaded with it, the encoder too."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from tonescale.functions import DIMENSIONS
from tonescale.operators.features import BatchEncoder, StoredVectors, described, fit_weighting, from_description
from tonescale.operators.fit import fit_multi
from tonescale.operators.score import LinearWeights, score_features
from tonescale.operators.wide import fit_wide

SOLVERS = {"products": fit_multi, "gradients": fit_wide}


def save_encoder(spark: SparkSession, encoder, path: str) -> dict:
    """What stands for an encoder in the metadata of a stage; stored vectors and supplied code are written below ``path``."""
    known = described(encoder)
    if known:
        return known
    if isinstance(encoder, StoredVectors):
        encoder.table.select(encoder.key, encoder.vector).write.parquet(f"{path}/vectors")
        return {"kind": "StoredVectors", "key": encoder.key, "vector": encoder.vector}
    kind = "BatchEncoder" if isinstance(encoder, BatchEncoder) else "code"
    code = cloudpickle.dumps(encoder.make if kind == "BatchEncoder" else encoder)
    spark.createDataFrame([(bytearray(code),)], "code binary").coalesce(1).write.parquet(f"{path}/code")
    return {"kind": kind} | ({"inputs": list(encoder.inputs), "batch_size": encoder.batch_size} if kind == "BatchEncoder" else {})


def load_encoder(spark: SparkSession, values: dict, path: str):
    """The encoder that ``save_encoder`` wrote. Supplied code is run: load models from places you trust."""
    values = dict(values)
    if values["kind"] == "StoredVectors":
        return StoredVectors(spark.read.parquet(f"{path}/vectors"), values["key"], values["vector"])
    if values["kind"] in ("BatchEncoder", "code"):
        made = pickle.loads(bytes(spark.read.parquet(f"{path}/code").first()["code"]))
        return made if values["kind"] == "code" else BatchEncoder(made, tuple(values["inputs"]), values["batch_size"])
    return from_description(values)


class _Stored(MLWritable, MLReadable):
    """Stages with parameters, and data that ``_save`` writes beside them and ``_restored`` reads."""

    def _save(self, spark: SparkSession, path: str) -> dict:
        return {}

    @classmethod
    def _restored(cls, spark: SparkSession, path: str, metadata: dict):
        return cls()

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata=self.instance._save(spark, path))


class _Reader(MLReader):
    def __init__(self, kind) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.kind._restored(self.sparkSession, path, metadata)
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        return made


class EncoderStage(Transformer, _Stored):
    """Adds ``features`` by any encoder of ``operators.features``, or another object with ``transform``."""

    def __init__(self, encoder=None) -> None:
        super().__init__()
        self.encoder = encoder

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.encoder.transform(dataset)

    def _save(self, spark: SparkSession, path: str) -> dict:
        return {"encoder": save_encoder(spark, self.encoder, path)}

    @classmethod
    def _restored(cls, spark: SparkSession, path: str, metadata: dict):
        return cls(load_encoder(spark, metadata["encoder"], path))


class TermWeighting(Estimator, _Stored):
    """Fits document frequencies and scales of another encoder's features; the model is the weighted encoder."""

    idf = Param(Params._dummy(), "idf", "weigh by document frequencies", TypeConverters.toBoolean)
    scale = Param(Params._dummy(), "scale", "divide by standard deviations", TypeConverters.toBoolean)
    center = Param(Params._dummy(), "center", "take means away", TypeConverters.toBoolean)

    def __init__(self, encoder=None, idf: bool = True, scale: bool = False, center: bool = False) -> None:
        super().__init__()
        self.encoder = encoder
        self._set(idf=idf, scale=scale, center=center)

    def _fit(self, dataset: DataFrame) -> EncoderStage:
        flags = [self.getOrDefault(p) for p in (self.idf, self.scale, self.center)]
        return EncoderStage(fit_weighting(dataset, self.encoder, *flags))

    def _save(self, spark: SparkSession, path: str) -> dict:
        return {"encoder": save_encoder(spark, self.encoder, path)}

    @classmethod
    def _restored(cls, spark: SparkSession, path: str, metadata: dict):
        return cls(load_encoder(spark, metadata["encoder"], path))


class DimensionModel(Model, _Stored):
    """Adds a prediction for each dimension, on the annotation scale."""

    suffix = Param(Params._dummy(), "suffix", "what follows the dimension in the name of its prediction", TypeConverters.toString)

    def __init__(self, weights: LinearWeights | None = None) -> None:
        super().__init__()
        self.weights = weights
        self._setDefault(suffix="_pred")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return score_features(dataset, self.weights, self.getOrDefault(self.suffix))

    def _save(self, spark: SparkSession, path: str) -> dict:
        self.weights.save(spark, f"{path}/weights")
        return {}

    @classmethod
    def _restored(cls, spark: SparkSession, path: str, metadata: dict):
        return cls(LinearWeights.load(spark, f"{path}/weights"))


class DimensionRegressor(Estimator, _Stored):
    """Least squares of all dimensions on ``features``, by cross products or, for any number of features, by gradients."""

    dims = Param(Params._dummy(), "dims", "the target columns", TypeConverters.toListString)
    size = Param(Params._dummy(), "size", "the number of features", TypeConverters.toInt)
    reg = Param(Params._dummy(), "reg", "the penalty", TypeConverters.toFloat)
    solver = Param(Params._dummy(), "solver", "products or gradients", TypeConverters.toString)

    def __init__(self, size: int = 256, dims: Sequence[str] = DIMENSIONS, reg: float = 0.01, solver: str = "products") -> None:
        super().__init__()
        self._set(size=size, dims=list(dims), reg=reg, solver=solver)

    def _fit(self, dataset: DataFrame) -> DimensionModel:
        size, dims, reg, solver = (self.getOrDefault(p) for p in (self.size, self.dims, self.reg, self.solver))
        return DimensionModel(SOLVERS[solver](dataset, size, dims, reg))
