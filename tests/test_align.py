import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonescale.operators import align, metrics
from tonescale.plans import jobs

PRED = "text string, V_pred double, A_pred double, D_pred double"
GOLD = "text string, V double, A double, D double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_id_wins_over_text(spark):
    p = frame(spark, [(1, "x", 1.0), (2, "y", 2.0)], "id long, text string, V_pred double")
    g = frame(spark, [(2, "x", 5.0), (3, "y", 6.0)], "id long, text string, V double")
    assert align.choose_key(p, g) == "id"
    (row,) = align.align(p, g).collect()
    assert (row.id, row.text_pred, row.text_gold, row.V_pred, row.V) == (2, "y", "x", 2.0, 5.0)


def test_repeated_texts_multiply(spark):
    p = frame(spark, [("x", float(i)) for i in range(2)], "text string, V_pred double")
    g = frame(spark, [("x", float(i)) for i in range(3)], "text string, V double")
    assert align.align(p, g).count() == 6
    counted = align.align_counted(p.unionAll(p), g, "text", ["V_pred"], ["V"])
    assert counted.count() == 6 and counted.agg(F.sum("n_rows")).first()[0] == 12


def test_missing_keys_pair_as_in_pandas(spark):
    p = frame(spark, [(None, 1.0), ("a", 2.0)], "text string, V_pred double")
    g = frame(spark, [(None, 3.0), (None, 4.0), ("a", 5.0)], "text string, V double")
    expected = len(pd.merge(p.toPandas(), g.toPandas(), on="text"))
    assert align.align(p, g).count() == expected == 3
    assert align.coverage(p, g, "text").first().n_aligned == 3


def test_plain_prediction_names_get_suffixes(spark):
    p = frame(spark, [(1, 1.0)], "id long, V double")
    g = frame(spark, [(1, 2.0)], "id long, V double")
    aligned = align.align(p, g)
    assert align.resolve_columns(aligned.columns, ["V"]) == {"V": ("V_gold", "V_pred")}


def test_colliding_names_are_refused(spark):
    p = frame(spark, [(1, 1.0, 1.0)], "id long, V double, V_pred double")
    g = frame(spark, [(1, 2.0)], "id long, V double")
    with pytest.raises(ValueError, match="twice"):
        align.align(p, g)


def test_missing_columns_are_named():
    with pytest.raises(ValueError, match="V_pred"):
        align.resolve_columns(["V"], ["V"])
    with pytest.raises(ValueError, match="gold column of dimension V"):
        align.resolve_columns(["V_pred"], ["V"])


def test_position_needs_equal_lengths(spark):
    p, g = spark.range(5).toDF("p"), spark.range(6).toDF("g")
    with pytest.raises(ValueError, match="cannot be paired"):
        align.align(p, g, "position", ["p"], ["g"])
    with pytest.raises(ValueError, match="order_preds"):
        align.align(p, g, "position")
    rows = align.align(p, g, "prefix", ["p"], [F.desc("g")]).orderBy("pos").collect()
    assert [(r.p, r.g) for r in rows] == [(0, 5), (1, 4), (2, 3), (3, 2), (4, 1)]
    with pytest.raises(ValueError, match="cannot be paired"):
        align.align(g.toDF("p"), p.toDF("g"), "prefix", ["p"], ["g"])


def test_coverage(spark):
    p = frame(spark, [("a",), ("a",), ("b",), ("c",)], "text string")
    g = frame(spark, [("a",), ("a",), ("a",), ("b",), ("d",), ("d",)], "text string")
    row = align.coverage(p, g, "text").first().asDict()
    assert row == {
        "n_pred": 4, "n_gold": 6, "n_aligned": 7, "lost_pred": 1, "lost_gold": 2, "repeated_keys": 1,
    }
    assert align.require_coverage(p, g, "text")["complete"]
    assert not align.require_coverage(p, p.limit(0).unionAll(g.filter("text = 'b'")), "text")["complete"]


def test_disjoint_keys_are_refused(spark):
    with pytest.raises(ValueError, match="no row in common"):
        align.require_coverage(spark.range(3), spark.range(5, 8), "id")


def test_evaluate_run_agrees_on_all_keys(spark):
    rows = [(i, f"t{i}", float(i % 5), 0.5 * i, 1.0) for i in range(40)]
    g = frame(spark, rows, "id long, text string, V double, A double, D double")
    p = g.select("id", "text", *[(F.col(d) + F.col("id") * 0.01).alias(f"{d}_pred") for d in "VAD"])
    by_id = jobs.evaluate_run(p, g)
    by_text = jobs.evaluate_run(p.drop("id"), g.drop("id"))
    by_place = jobs.evaluate_run(
        p.drop("text").withColumnRenamed("id", "i"), g.drop("text").withColumnRenamed("id", "j"),
        order_preds=["i"], order_gold=["j"],
    )
    want = {r.dim: (r.n, round(r.mae, 9), round(r.pearson_r, 9)) for r in by_id.collect()}
    assert want["D"][2] == 0.0
    for other in (by_text, by_place):
        assert {r.dim: (r.n, round(r.mae, 9), round(r.pearson_r, 9)) for r in other.collect()} == want


def test_pairs_on_a_hot_text_without_forming_them(spark):
    """One text holds most rows; every value differs. The pairs would be 4,000 x 3,000."""
    p = spark.range(5000).select(
        F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"),
        (1 + (F.col("id") * 37 % 4001) / 1000.0).alias("V_pred"),
    )
    g = spark.range(4000).select(
        F.when(F.col("id") < 3000, F.lit("hot")).otherwise((F.col("id") + 1000).cast("string")).alias("text"),
        (1 + (F.col("id") * 53 % 3989) / 997.0).alias("V"),
    )
    got = metrics.evaluate_pairs(p, g, dims=["V"]).first()
    merged = pd.merge(p.toPandas(), g.toPandas(), on="text")
    assert got.n == len(merged)
    assert got.mae == pytest.approx((merged.V - merged.V_pred).abs().mean(), rel=1e-9)
    assert got.pearson_r == pytest.approx(merged.V.corr(merged.V_pred), abs=1e-9)
