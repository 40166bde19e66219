"""Encoders and fits as stages of Spark ML pipelines."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tonescale.operators import features, fit
from tonescale.plans import jobs, stages


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, 1.0 + t.count("good"), 3.0 - t.count("bad"), 2.0 + i % 3) for i, t in enumerate(["good day", "bad day", "good good", "x bad bad", "day", "good bad", "", "bad x"] * 4)]
    return spark.createDataFrame(rows, "id long, text string, V double, A double, D double")


TEXTS = [(1, "good"), (2, "bad day"), (3, None), (4, "")]


def supplied():
    """Code that no module on the executors has."""

    def lengths():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=float)

    class Twice:
        def transform(self, df):
            n = F.length("text").cast("double")
            return df.withColumn("features", F.when(F.col("text").isNotNull(), F.array(n, n * n)))

    return features.BatchEncoder(lengths, batch_size=3), Twice()


@pytest.mark.parametrize("name, size", [("hashed", 32), ("sparse", 64), ("supplied", 2), ("vectors", 2), ("own", 2)])
def test_pipelines_are_stored_with_their_encoder(spark, table, tmp_path, name, size):
    vectors = spark.createDataFrame([(i, [float(i), float(i % 5)], "x") for i in range(40)], "id long, embedding array<float>, other string")
    encoder = {
        "hashed": features.HashedTerms(32),
        "sparse": features.SparseTerms(64),
        "supplied": supplied()[0],
        "vectors": features.StoredVectors(vectors),
        "own": supplied()[1],
    }[name]
    solver = "gradients" if name == "sparse" else "products"
    regressor = stages.DimensionRegressor(size, reg=0.05, solver=solver)
    plan = Pipeline(stages=[stages.EncoderStage(encoder), regressor])
    plan.write().overwrite().save(str(tmp_path / "plan"))
    fitted = Pipeline.load(str(tmp_path / "plan")).fit(table)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert [s.uid for s in again.stages] == [s.uid for s in fitted.stages]
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    a, b = (m.transform(texts).drop("features").orderBy("id").collect() for m in (fitted, again))
    assert a == b and len(a) == 4
    known = fit.fit_multi(encoder.transform(table), size, reg=0.05) if name != "sparse" else fitted.stages[1].weights
    assert np.allclose(again.stages[1].weights.weights, known.weights, atol=1e-9)
    assert (a[2]["V_pred"] is None) == (name != "vectors")


def test_weighting_is_fitted_within_the_pipeline(spark, table, tmp_path):
    plan = Pipeline(stages=[stages.TermWeighting(features.HashedTerms(32), idf=True, scale=True), stages.DimensionRegressor(32, ["V", "A"], reg=0.1)])
    plan.save(str(tmp_path / "plan"))
    fitted = Pipeline.load(str(tmp_path / "plan")).fit(table)
    fitted.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.stages[0].encoder == features.fit_weighting(table, features.HashedTerms(32), True, True)
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    scored = {r.id: r for r in again.transform(texts).collect()}
    assert scored[1].V_pred > scored[2].V_pred and scored[3].V_pred is None and "D_pred" not in scored[1].asDict()
    model = jobs.train_joint(table.withColumn("split", F.lit("train")), encoder=again.stages[0].encoder, dims=["V", "A"], reg=0.1)
    assert np.allclose(model.weights, again.stages[1].weights.weights)


def test_copies_keep_parameters(table):
    regressor = stages.DimensionRegressor(32, ["V"], reg=0.5)
    copied = regressor.copy({regressor.reg: 0.25})
    assert copied.getOrDefault(copied.reg) == 0.25 and regressor.getOrDefault(regressor.reg) == 0.5
    model = copied.fit(features.HashedTerms(32).transform(table))
    model.set(model.suffix, "_hat")
    assert "V_hat" in model.transform(features.HashedTerms(32).transform(table)).columns
