import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonescale.operators import metrics, position

NAN = float("nan")


def evaluate(spark, y, p, **settings):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(y, p, strict=True))]
    df = spark.createDataFrame(rows, "id long, V double, V_pred double").repartition(3)
    return metrics.evaluate(df, ["V"], **settings).first()


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(3, 1, 500), rng.normal(3, 1, 500)
    row = evaluate(spark, y.tolist(), p.tolist())
    assert (row.n, row.n_missing) == (500, 0)
    assert row.mae == pytest.approx(np.abs(y - p).mean())
    assert row.pearson_r == pytest.approx(np.corrcoef(y, p)[0, 1])


@pytest.mark.parametrize(
    ("y", "p", "r"),
    [
        ([3.0, 3.0, 3.0], [1.0, 2.0, 3.0], 0.0),
        ([1.0, 2.0, 3.0], [2.0, 2.0, 2.0], 0.0),
        ([1000.0, 1000.001, 1000.002], [1.0, 2.0, 3.0], 0.0),  # within 1e-5 of the first value
        ([1000.0, 1000.1, 1000.2], [1.0, 2.0, 3.0], 1.0),
        ([1.0], [2.0], 0.0),
        ([1.0, 2.0, 3.0], [2.0, 4.0, 6.0], 1.0),
        ([1.0, 2.0, 3.0], [-2.0, -4.0, -6.0], -1.0),
    ],
)
def test_guarded_correlation(spark, y, p, r):
    assert evaluate(spark, y, p).pearson_r == pytest.approx(r)


def test_constant_in_many_partitions(spark):
    """Merging partial moments must not turn a constant column into a varying one."""
    df = spark.range(10000).repartition(31).select("id", F.lit(0.1).alias("V"), F.rand(3).alias("V_pred"))
    assert metrics.evaluate(df, ["V"]).first().pearson_r == 0.0
    assert metrics.evaluate(df, ["V"], on_constant="null").first().pearson_r is None


def test_incomplete_rows_are_counted_and_left_out(spark):
    row = evaluate(spark, [1.0, None, NAN, 2.0, 3.0], [1.5, 1.0, 1.0, None, 2.0])
    assert (row.n, row.n_missing, row.mae) == (2, 3, 0.75)


def test_no_rows(spark):
    row = evaluate(spark, [None], [1.0])
    assert (row.n, row.mae, row.pearson_r) == (0, None, 0.0)


def test_automatic_rescale_in_the_same_pass(spark):
    y = [1.0, 3.0, 5.0]
    assert evaluate(spark, y, [0.2, 0.6, 1.0], auto_unscale=True).mae == pytest.approx(0.0)
    assert evaluate(spark, y, [0.2, 0.6, 1.1], auto_unscale=True).mae == pytest.approx((0.8 + 2.4 + 3.9) / 3)
    # A row without gold still counts for the maximum.
    assert evaluate(spark, [1.0, None], [0.2, 4.0], auto_unscale=True).mae == pytest.approx(0.8)


def test_groups(spark):
    df = spark.range(90).select(
        F.when(F.col("id") < 60, "hot").otherwise("cold").alias("run"),
        "id",
        (F.col("id") % 7).cast("double").alias("V"),
        (F.col("id") % 5).cast("double").alias("V_pred"),
    )
    got = {r.run: r for r in metrics.evaluate(df, ["V"], by=["run"]).collect()}
    for run, part in df.toPandas().groupby("run"):
        assert got[run].n == len(part)
        assert got[run].pearson_r == pytest.approx(part.V.corr(part.V_pred))


def test_evaluate_is_one_aggregate(spark):
    df = spark.range(10).selectExpr("id", *[f"double(id) {c}" for c in ("V", "A", "D", "V_pred", "A_pred", "D_pred")])
    plan = metrics.evaluate(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan and "Window" not in plan and "Sort" not in plan


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(-4, 9, width=32))),
        min_size=1, max_size=25,
    ),
    st.lists(
        st.tuples(st.sampled_from(["a", "b", "c", None]), st.one_of(st.none(), st.floats(1, 5, width=32))),
        min_size=1, max_size=25,
    ),
)
def test_pairs_equal_the_formed_pairs(spark, preds, gold):
    p = spark.createDataFrame(preds, "text string, V_pred double")
    g = spark.createDataFrame(gold, "text string, V double")
    pairs = [(y, q) for t, q in preds for s, y in gold if t == s]
    rows = metrics.evaluate_pairs(p, g, dims=["V"]).collect()
    if not pairs:
        assert rows == []
        return
    complete = [(y, q) for y, q in pairs if y is not None and q is not None]
    (row,) = rows
    assert (row.n, row.n_missing) == (len(complete), len(pairs) - len(complete))
    if not complete:
        assert row.mae is None
        return
    y, q = np.array(complete).T
    assert row.mae == pytest.approx(np.abs(y - q).mean(), abs=1e-9)
    if y.std() > 1e-3 and q.std() > 1e-3:
        assert row.pearson_r == pytest.approx(np.corrcoef(y, q)[0, 1], abs=1e-6)
    if len(set(y)) == 1 or len(set(q)) == 1:
        assert row.pearson_r == 0.0


def test_pairs_never_join(spark):
    p = spark.createDataFrame([("a", 1.0)], "text string, V_pred double")
    g = spark.createDataFrame([("a", 1.0)], "text string, V double")
    plan = metrics.evaluate_pairs(p, g, dims=["V"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_short_last_batch_counts_in_full(spark):
    df = spark.range(33).select("id", F.lit(0.0).alias("V"), F.when(F.col("id") == 32, 3.0).otherwise(1.0).alias("V_pred"))
    placed = position.with_position(df, ["id"]).withColumn("batch_id", position.batch_of("pos"))
    row = metrics.epoch_loss(metrics.batch_losses(placed, [("V", "V_pred")])).first()
    assert (row.n_batches, row.loss) == (3, pytest.approx((0.5 + 0.5 + 2.5) / 3))


def test_joint_loss_is_the_mean_over_targets(spark):
    df = spark.createDataFrame([(0, 1.0, 2.5, 3.0, 3.0)], "batch_id long, V double, V_pred double, A double, A_pred double")
    row = metrics.batch_losses(df, [("V", "V_pred"), ("A", "A_pred")]).first()
    assert row.batch_loss == pytest.approx((1.0 + 0.0) / 2)


def test_any_present(spark):
    df = spark.createDataFrame([(None, NAN, 1.0), (None, None, NAN)], "a double, b double, c double")
    assert metrics.any_present(df, ["a", "b", "c"]).first().asDict() == {"a": False, "b": False, "c": True}
    assert metrics.any_present(df.limit(0), ["a"]).first().a is False


def test_symmetric_and_bounded(spark):
    rng = np.random.default_rng(5)
    y, p = rng.random(50).tolist(), rng.random(50).tolist()
    a, b = evaluate(spark, y, p).pearson_r, evaluate(spark, p, y).pearson_r
    assert a == pytest.approx(b) and -1.0 <= a <= 1.0
    assert not math.isnan(a) and pd.notna(a)


def test_text_ids_do_not_sort_the_rows(spark):
    df = spark.createDataFrame([("10", 1.0, 1.5), ("9", 2.0, 2.5), ("x", 3.0, 2.0)], "id string, V double, V_pred double")
    found = metrics.evaluate(df, ["V"], order="id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert found.first().n == 3
