import math

import pytest

from tonescale import sources
from tonescale.operators import report
from tonescale.plans import jobs

# Recorded figures, used to test the reading of reports.
SINGLE = {
    "v.txt": "Evaluation - V\n=====\n\nV:\n  MAE = 0.3638\n  Pearson’s r = 0.6324\n\n",
    "a.txt": "Evaluation - A\n=====\n\nA:\n  MAE = 0.3097\n  Pearson’s r = 0.5572\n\n",
    "d.txt": "Evaluation - D\n=====\n\nD:\n  MAE = 0.2870\n  Pearson’s r = 0.5407\n\n",
}
JOINT = (
    "Evaluation\n=====\n\nV:\n  MAE = 0.3231\n  Pearson’s r = 0.7110\n\nA:\n  MAE = 0.3010\n  Pearson’s r = 0.5888\n\n"
    "D:\n  MAE = 0.2805\n  Pearson’s r = 0.5976\n\n"
)
ODD = (
    "MAE = 9.9\nV:\n  MAE = 0.5\n  Pearson’s r = -0.1200\nA:\n  Pearson’s r = 0.3\nD:\r\n  MAE = 0.1\n  MAE = 0.2\n"
    "V:\n  MAE = 0.7\n  Pearson’s r = nan\n"
)


def reports(spark, texts):
    return spark.createDataFrame(list(texts.items()), "run string, value string")


def sections(spark, text):
    return report.parse_sections(report.report_lines(reports(spark, {"r": text})))


def test_sections(spark):
    rows = report.table_sections(sections(spark, JOINT)).orderBy("section_no").collect()
    assert [(r.dimension, r.mae, r.pearson_r) for r in rows] == [
        ("Valence", 0.3231, 0.711),
        ("Arousal", 0.301, 0.5888),
        ("Dominance", 0.2805, 0.5976),
    ]


def test_odd_sections(spark):
    parsed = sections(spark, ODD)
    rows = {r.section_no: r for r in parsed.collect()}
    assert (rows[1].dim, rows[1].mae, rows[1].pearson_r) == ("V", 0.5, -0.12)
    assert (rows[2].dim, rows[2].mae, rows[2].pearson_r) == ("A", None, 0.3)
    assert (rows[3].dim, rows[3].mae, rows[3].pearson_r) == ("D", 0.2, None)
    assert rows[4].mae == 0.7 and math.isnan(rows[4].pearson_r)
    # No row without an MAE; a missing correlation is allowed.
    assert sorted(r.section_no for r in report.table_sections(parsed).collect()) == [1, 3, 4]
    last = {r.dim: r.mae for r in report.last_sections(parsed).collect()}
    assert last == {"V": 0.7, "A": None, "D": 0.2}


def test_first_and_last_line(spark):
    texts = {
        "two": "MAE = 0.1\nPearson’s r = 0.2\nMAE = 0.3\nPearson’s r = 0.4",
        "bad_first": "MAE unknown\nMAE = 0.3\nPearson’s r = 0.4",
        "no_r": "MAE = 0.3",
    }
    lines = report.report_lines(reports(spark, texts))
    first = {r.run: (r.mae, r.pearson_r) for r in report.parse_single(lines, keep="first").collect()}
    last = {r.run: (r.mae, r.pearson_r) for r in report.parse_single(lines, keep="last").collect()}
    assert first == {"two": (0.1, 0.2), "bad_first": (None, 0.4), "no_r": (0.3, None)}
    assert last == {"two": (0.3, 0.4), "bad_first": (0.3, 0.4), "no_r": (0.3, None)}
    parsed = report.parse_single(lines)
    assert [r.dimension for r in report.table_single(parsed, "run").collect()] == ["two"]


def test_compare_reports_with_a_missing_file(spark):
    single = reports(spark, {k: v for k, v in SINGLE.items() if k != "a.txt"})
    files = {"V": "v.txt", "A": "a.txt", "D": "d.txt"}
    table = jobs.compare_reports(single, reports(spark, {"joint": JOINT}), files)
    rows = {r.dimension: r for r in table.collect()}
    assert list(rows) == ["Valence", "Arousal", "Dominance"]
    assert (rows["Valence"].mae_a, rows["Valence"].pearson_r_b) == (0.3638, 0.711)
    assert (rows["Arousal"].mae_a, rows["Arousal"].pearson_r_a, rows["Arousal"].mae_b) == (None, None, 0.301)
    assert report.chart_long(table).count() == 10
    nothing = jobs.compare_reports(single.limit(0), single.limit(0), files)
    assert nothing.count() == 3 and report.chart_long(nothing).count() == 0


def test_render_write_read(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("x y", "D", 0.28051, 0.5), ("x y", "V", 0.1, -0.25), ("z", "A", 1.0, 0.0)],
        "run string, dim string, mae double, pearson_r double",
    )
    rendered = report.render_report(metrics)
    text = {r.run: r.value for r in rendered.collect()}["x y"]
    assert text == (
        "Evaluation - x y\n================\n\nV:\n  MAE = 0.1000\n  Pearson’s r = -0.2500\n\n"
        "D:\n  MAE = 0.2805\n  Pearson’s r = 0.5000\n\n"
    )
    sources.write_reports(rendered, str(tmp_path / "r"))
    again = sources.read_reports(spark, str(tmp_path / "r"))
    got = {(r.run, r.dim): (r.mae, r.pearson_r) for r in report.parse_sections(report.report_lines(again)).collect()}
    assert got == {("x y", "V"): (0.1, -0.25), ("x y", "D"): (0.2805, 0.5), ("z", "A"): (1.0, 0.0)}


def test_flat_folder_of_reports(spark, tmp_path):
    for name, text in SINGLE.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    parsed = report.parse_single(report.report_lines(sources.read_reports(spark, str(tmp_path))))
    assert {r.run: r.mae for r in parsed.collect()} == {"v.txt": 0.3638, "a.txt": 0.3097, "d.txt": 0.287}


def test_learning_curve(spark):
    train = spark.createDataFrame([("r", 1, 0.3), ("r", 2, 0.2)], "run string, epoch int, loss double")
    rows = report.learning_curve(train, train.filter("epoch = 1")).orderBy("epoch").collect()
    assert [(r.train_loss, r.val_loss) for r in rows] == [(0.3, 0.3), (0.2, None)]
    assert report.learning_curve(train).filter("val_loss is not null").count() == 0


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="keep"):
        report.parse_single(report.report_lines(reports(spark, SINGLE)), keep="best")
