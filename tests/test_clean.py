import math

import pytest
from pyspark.sql import functions as F

from tonescale.functions import fixed4, number_after_equals, smooth_l1, to_number, tokens
from tonescale.operators import clean

NAN = float("nan")


def test_missing_rows_are_null_or_nan(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, 2.0, 3.0), (2, None, 1.0, 2.0, 3.0), (3, "c", NAN, 2.0, 3.0), (4, "d", None, None, None)],
        "id long, text string, V double, A double, D double",
    )
    assert [r.id for r in clean.clean_annotated(df).collect()] == [1]
    assert sorted(r.id for r in clean.drop_missing(df, ["V", "A", "D"], "all").collect()) == [1, 2, 3]
    # With only some of the targets a table counts as unlabelled.
    assert sorted(r.id for r in clean.clean_annotated(df.drop("D")).collect()) == [1, 3, 4]


def test_text_is_required(spark):
    with pytest.raises(ValueError, match="text"):
        clean.clean_annotated(spark.range(1))


def test_targets_that_are_no_numbers_fail(spark):
    df = spark.createDataFrame([("a", "x")], "text string, V string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.cast_targets(df, ["V"]).collect()


def test_auto_unscale_per_column(spark):
    df = spark.createDataFrame([(0.4, 1.5, NAN), (1.0 + 1e-9, 0.5, 0.2)], "a double, b double, c double")
    rows = clean.auto_unscale(df, ["a", "b", "c"]).orderBy("b").collect()
    assert [r.a for r in rows] == pytest.approx([5.0, 2.0])
    assert [r.b for r in rows] == [0.5, 1.5]
    assert rows[0].c == pytest.approx(1.0) and math.isnan(rows[1].c)


def test_auto_unscale_of_nothing_changes_nothing(spark):
    df = spark.createDataFrame([(None,), (NAN,)], "a double")
    assert sorted(map(str, (r.a for r in clean.auto_unscale(df, ["a"]).collect()))) == ["None", "nan"]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.5", 1.5), (" -2 ", -2.0), ("1e3", 1000.0), ("x", None), ("", None), ("1d", None), ("1.2.3", None), (None, None)],
)
def test_lenient_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(to_number("s")).first()[0] == value


@pytest.mark.parametrize(
    ("line", "label", "value"),
    [
        ("MAE = 0.3638", "MAE", 0.3638),
        ("MAE=-0.5", "MAE", -0.5),
        ("MAE : 0.5", "MAE", None),
        ("Pearson’s r = -0.1200", None, -0.12),
        ("Pearson (a=b) = 0.5", None, 0.5),
        ("Pearson’s r = n/a", None, None),
    ],
)
def test_number_of_a_line(spark, line, label, value):
    assert spark.range(1).select(number_after_equals(F.lit(line), label)).first()[0] == value


def test_nan_of_a_line(spark):
    assert math.isnan(spark.range(1).select(number_after_equals(F.lit("Pearson’s r = nan"))).first()[0])


def test_smooth_l1_has_two_branches(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.5,), (0.0,), (None,)], "e double")
    assert [r[0] for r in df.select(smooth_l1("e")).collect()] == [1.5, 0.5, 0.125, 0.0, None]


def test_fixed4(spark):
    assert [r[0] for r in spark.createDataFrame([(0.31,), (-1.00004,)], "x double").select(fixed4("x")).collect()] == [
        "0.3100",
        "-1.0000",
    ]


def test_tokens(spark):
    df = spark.createDataFrame([(" a\tb\n c ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(tokens("s")).collect()] == [["a", "b", "c"], [], None]


def test_head(spark):
    df = spark.range(10).repartition(3)
    assert [r.id for r in clean.head_rows(df, "id").collect()] == [0, 1, 2]
