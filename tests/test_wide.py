"""Fits on many features, sparse features and their statistics."""

import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescale.operators import features, fit, score, wide
from tonescale.plans import jobs

DIMS = ("V", "A", "D")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 64)) * rng.uniform(0.1, 5.0, 64) + rng.normal(size=64)
    x[:, 60] = 2.0
    x[:, 61] = x[:, 0]
    x[rng.random((400, 64)) < 0.3] = 0.0
    y = 3 + x @ rng.normal(scale=0.1, size=(64, 3)) + rng.normal(scale=0.2, size=(400, 3))
    rows = [(i, x[i].tolist(), *map(float, y[i])) for i in range(400)]
    rows += [(1000, None, 1.0, 1.0, 1.0), (1001, [0.0] * 64, None, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, features array<double>, V double, A double, D double").repartition(3)
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("features", i) != 0.0)
    sparse = F.struct(places.alias("indices"), F.transform(places, lambda i: F.get("features", i)).alias("values"))
    return df.withColumn("sparse", F.when(F.col("features").isNotNull(), sparse)).cache()


@pytest.mark.parametrize("column", ["features", "sparse"])
@pytest.mark.parametrize("reg", [0.05, 1.0])
def test_gradients_agree_with_cross_products(table, column, reg):
    found, known = wide.fit_wide(table, 64, reg=reg, column=column), fit.fit_multi(table, 64, reg=reg)
    assert np.allclose(found.weights, known.weights, atol=1e-8) and np.allclose(found.intercepts, known.intercepts, atol=1e-8)


def test_without_penalty_predictions_agree(table):
    found, known = wide.fit_wide(table, 64, reg=0.0), fit.fit_multi(table, 64, reg=0.0)
    a, b = (score.score_features(table.drop("V", "A", "D"), m).orderBy("id").toPandas() for m in (found, known))
    for d in DIMS:
        assert np.allclose(a[f"{d}_pred"], b[f"{d}_pred"], atol=1e-6, equal_nan=True)


def test_long_tables_are_fitted_on_their_own_rows(table):
    some = table.withColumn("A", F.when(F.col("id") % 3 != 0, F.col("A")))
    long = some.unpivot(["features"], list(DIMS), "dim", "value")
    found, known = wide.fit_wide_long(long, 64, reg=0.1), fit.fit_long(long, 64, reg=0.1)
    assert np.allclose(found.weights, known.weights, atol=1e-8) and np.allclose(found.intercepts, known.intercepts, atol=1e-8)
    with pytest.raises(ValueError, match="dimension D"):
        wide.fit_wide_long(long.filter("dim <> 'D'"), 64)


def test_constant_targets_and_columns(spark, table):
    flat = table.withColumn("V", F.lit(2.5))
    found = wide.fit_wide(flat, 64, reg=0.05)
    assert not found.weights[0].any() and found.intercepts[0] == pytest.approx(0.5)
    assert abs(found.weights[1]).max() > 0


WIDE = """
import resource, sys
import numpy as np
from pyspark.sql import functions as F
from tonescale import build_session
from tonescale.operators import wide
spark = build_session("wide", master="local[2]", **{"spark.ui.enabled": "false", "spark.driver.memory": "1g", "spark.sql.shuffle.partitions": "4"})
size = 20_000
at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(size)).cast("int")
rows = spark.range(60_000).select(
    F.struct(F.array(*[at(k) for k in range(5)]).alias("indices"), F.array(*[F.lit(1.0)] * 5).alias("values")).alias("features"),
    (F.col("id") % 7).cast("double").alias("V"), (at(0) % 5).cast("double").alias("A"))
model = wide.fit_wide(rows, size, ["V", "A"], reg=0.001, tolerance=1e-6)
assert model.weights.shape == (2, size) and abs(model.weights[1]).max() > 0
print("peak", resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_twenty_thousand_features_in_a_driver_of_one_gigabyte(tmp_path):
    ran = subprocess.run([sys.executable, "-c", textwrap.dedent(WIDE)], capture_output=True, text=True, timeout=400)
    assert "peak" in ran.stdout, ran.stderr[-2000:]
    assert int(ran.stdout.split()[-1]) < 1000


def test_sparse_terms_count_words(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, None), (3, ""), (4, "b")], "id long, text string").repartition(2)
    got = {r.id: r.features for r in features.SparseTerms(1 << 16, log=False).transform(df).collect()}
    assert sorted(got[1]["values"]) == [1.0, 1.0, 2.0] and got[1]["indices"] == sorted(got[1]["indices"])
    assert got[2] is None and list(got[3]["indices"]) == [] and got[4]["indices"][0] in got[1]["indices"]
    few = {r.id: r.features for r in features.SparseTerms(1, log=False).transform(df).collect()}
    assert list(few[1]["values"]) == [4.0]


@pytest.mark.parametrize("encoder", [features.HashedTerms(32), features.SparseTerms(32)])
@pytest.mark.parametrize("idf, scale", [(True, False), (True, True), (False, True)])
def test_weighting_against_numpy(spark, encoder, idf, scale):
    texts = ["a b", "a a a", "b c", "", "a", None, "c c b a", "a z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)

    def dense(rows):
        found = {r.id: r.features for r in rows.collect()}
        if encoder.__class__ is features.SparseTerms:
            found = {i: f and [dict(zip(f["indices"], f["values"])).get(j, 0.0) for j in range(32)] for i, f in found.items()}
        return found

    raw, made = dense(encoder.transform(df)), dense(features.fit_weighting(df, encoder, idf, scale).transform(df))
    x = np.array([raw[i] for i in sorted(raw) if raw[i] is not None])
    weighted = x * np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) if idf else x
    if scale:
        spread = weighted.std(0, ddof=1)
        weighted = np.where(spread > 1e-12, weighted / np.where(spread > 1e-12, spread, 1), 0.0)
    assert made[5] is None
    assert np.allclose([made[i] for i in sorted(made) if i != 5], weighted, atol=1e-12)


def test_weighted_models_are_stored_with_their_statistics(spark, tmp_path):
    rows = [(i, t, "train" if i % 4 else "val", 1.0 + t.count("good"), 3.0 - t.count("bad"), 2.0) for i, t in enumerate(["good day", "bad day", "good good", "x bad bad", "day", "good bad", "", "bad x"] * 5)]
    parts = spark.createDataFrame(rows, "id long, text string, split string, V double, A double, D double")
    encoder = features.fit_weighting(parts.filter("split = 'train'"), features.SparseTerms(1 << 12))
    model = jobs.train_joint(parts, encoder=encoder, reg=0.01, solver="gradients")
    model.save(spark, str(tmp_path / "m"))
    again = score.LinearWeights.load(spark, str(tmp_path / "m"))
    assert again.encoder == encoder
    texts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id long, text string")
    a, b = ({r.id: r.V_pred for r in jobs.predict(texts, m).collect()} for m in (model, again))
    assert a == b and a[1] > a[2] and a[3] is None
    single = jobs.train_single(parts, encoder, reg=0.01, solver="gradients")
    assert np.allclose(single.weights, model.weights, atol=1e-8)
    with pytest.raises(ValueError, match="centred"):
        features.fit_weighting(parts, features.SparseTerms(8), center=True).transform(parts)
    with pytest.raises(ValueError, match="statistics"):
        features.fit_weighting(parts.limit(0), features.HashedTerms(8))
