import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonescale import sources
from tonescale.functions import MISSING_TOKENS
from tonescale.operators import profile, split
from tonescale.plans import jobs

TRICKY = [
    "plain", "comma, inside", 'a "quoted" word', "line\nbreak", "  spaces kept  ", "", *MISSING_TOKENS, "NA inside", "è ù",
]


def rows_of(df):
    return [tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False)]


def test_csv_reads_as_pandas_does(spark, tmp_path):
    path = tmp_path / "dev.csv"
    pd.DataFrame(
        {"id": range(len(TRICKY)), "text": TRICKY, "V": [1.5] * len(TRICKY), "A": ["2", "NA"] + ["3"] * (len(TRICKY) - 2)}
    ).to_csv(path, index=False)
    ours = sources.read_annotated(spark, str(path)).toPandas()
    ours["id"] = ours["id"].astype(int)
    assert rows_of(ours) == rows_of(pd.read_csv(path))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, t or None) for i, t in enumerate(TRICKY) if t not in MISSING_TOKENS], "id int, text string")
    sources.write_csv(df, str(tmp_path / "out"))
    again = sources.read_texts(spark, str(tmp_path / "out"))
    assert sorted((int(r.id), r.text) for r in again.collect()) == sorted((r.id, r.text) for r in df.collect())


def test_text_column_is_required(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="text"):
        sources.read_annotated(spark, str(tmp_path / "x.csv"))


def test_files_of_a_folder_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,V,A,D\n1,x,10,20,30\n")
    (tmp_path / "b.csv").write_text('text,D,A,V,note,id\n"y, z",30,20,10,n,2\n')
    (tmp_path / "c.csv").write_text("id,text\n3,w\n")
    rows = sources.read_annotated(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.text, r.V, r.A, r.D, r.note) for r in rows] == [
        (1, "x", 10.0, 20.0, 30.0, None), (2, "y, z", 10.0, 20.0, 30.0, "n"), (3, "w", None, None, None, None),
    ]


def test_tables_without_ids_get_them(spark, tmp_path):
    (tmp_path / "dev.csv").write_text("text,V,A,D\n" + "".join(f"t{i},1,2,3\n" for i in range(20)))
    df = sources.import_annotated(spark, str(tmp_path / "dev.csv"), str(tmp_path / "dev.parquet"))
    assert [(r.id, r.text) for r in df.orderBy("id").collect()] == [(i + 1, f"t{i}") for i in range(20)]
    assert jobs.prepare_joint(df).filter("split = 'train'").count() == 16
    (tmp_path / "named.csv").write_text("id,text\na1,x\n2,y\n")
    assert {r.id for r in sources.read_texts(spark, str(tmp_path / "named.csv")).collect()} == {"a1", "2"}


def test_import(spark, tmp_path):
    (tmp_path / "dev.csv").write_text('id,text,V,A,D\n1,"a,b",1,2,3\n2,c,,2,3\n')
    df = sources.import_annotated(spark, str(tmp_path / "dev.csv"), str(tmp_path / "dev.parquet"))
    assert [(r.text, r.V) for r in df.orderBy("id").collect()] == [("a,b", 1.0), ("c", None)]


def test_split_tables(spark, tmp_path):
    df = spark.range(20).select("id", F.lit("t").alias("text"), *[F.lit(1.0).alias(d) for d in "VAD"])
    long = split.to_long(split.split_exact(df), keep=("id", "text", "split"))
    sources.write_splits(long, str(tmp_path / "s"))
    part = spark.read.parquet(str(tmp_path / "s" / "dim=V" / "split=val"))
    assert part.count() == 4 and set(part.columns) == {"id", "text", "value"}


def test_predictions_of_two_sets_do_not_overwrite(spark, tmp_path):
    df = spark.range(3)
    a = sources.write_predictions(df, str(tmp_path), "r1", "val")
    b = sources.write_predictions(df.limit(1), str(tmp_path), "r1", "test", fmt="csv")
    assert a != b and spark.read.parquet(a).count() == 3 and spark.read.option("header", True).csv(b).count() == 1
    assert {r.eval_set for r in spark.read.parquet(str(tmp_path / "run=r1" / "eval_set=val")).withColumn("eval_set", F.lit("val")).collect()} == {"val"}


def test_loss_logs(spark, tmp_path):
    losses = spark.createDataFrame(
        [("a", 2, 0.0103), ("a", 1, 0.02212), ("b", 1, 0.5)], "run string, epoch int, loss double"
    )
    sources.write_loss_log(losses, str(tmp_path / "log"))
    (part,) = (tmp_path / "log" / "run=a").glob("part-*")
    assert part.read_text() == "1,0.0221\n2,0.0103\n"
    log = sources.read_loss_log(spark, str(tmp_path / "log" / "run=a"))
    assert [(r.epoch, r.loss) for r in log.orderBy("epoch").collect()] == [(1, 0.0221), (2, 0.0103)]
    both = sources.read_loss_log(spark, str(tmp_path / "log"))
    assert {(r.run, r.epoch, r.loss) for r in both.collect()} == {("a", 1, 0.0221), ("a", 2, 0.0103), ("b", 1, 0.5)}
    assert sources.read_loss_log(spark, str(tmp_path / "none"), required=False) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_loss_log(spark, str(tmp_path / "none"))


def test_appending_leaves_other_runs_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("a", 1, 0.3), ("b", 1, 0.4)], "run string, epoch int, loss double")
    sources.append_losses(one, path)
    sources.append_losses(one.filter("run = 'a'").withColumn("loss", F.lit(0.1)), path)
    assert {r.run: r.loss for r in spark.read.parquet(path).collect()} == {"a": 0.1, "b": 0.4}


FILES = {
    "good.csv": 'text,V\n"a, b",1.5\n"c\nd",\n',
    "no text.csv": "V,A\n1,2\n",
    "one.csv": "text\nx\n",
    "four.csv": "id,text,V,A\n1,a,1,2\n2,b,1,2\n3,c,NA,2\n",
    "words.csv": "text,V\na,high\nb,1\n",
    "bool.csv": "text,V\na,True\nb,False\n",
    "mixed.csv": "text,V\na,True\nb,1\n",
    "header only.csv": "text,V\n",
    "empty.csv": "",
    "short.csv": "text,V\na,1\nb,2,3,4\n",
    "ragged.csv": "text,V\n" + ",".join("x" * 70) + "\n",
    "wide.csv": "text," + ",".join(f"f{i}" for i in range(80)) + "\n" + ",".join(["x", *"1" * 80]) + "\n",
}


def test_profile_of_a_folder(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    got = {r.name: r for r in profile.profile_folder(spark, str(tmp_path)).collect()}
    assert set(got) == set(FILES)

    def row(name):
        r = got[name]
        return r.columns, r.n_rows, r.has_text, r.two_columns, r.target, r.target_numeric, r.error

    assert row("good.csv") == ("text,V", 2, True, True, "V", True, None)
    assert row("no text.csv") == ("V,A", 1, False, True, "V", True, None)
    assert row("one.csv") == ("text", 1, True, False, None, None, None)
    assert row("four.csv") == ("id,text,V,A", 3, True, False, "id", True, None)
    assert row("words.csv") == ("text,V", 2, True, True, "V", False, None)
    assert row("bool.csv")[5] is True and row("mixed.csv")[5] is False
    assert row("header only.csv")[:2] == ("text,V", 0) and row("header only.csv")[5] is False
    assert row("empty.csv")[6] == "no columns"
    assert row("short.csv")[6] == "more fields than header names"
    assert row("ragged.csv")[6] == "more fields than header names"
    assert row("wide.csv")[6] is None and row("wide.csv")[1] == 1


def test_profile_of_a_table(spark):
    df = spark.createDataFrame([("a", "x", 1)], "text string, s string, n int")
    row = profile.profile_table(df, "t").first()
    assert (row["columns"], row.n_rows, row.target, row.target_numeric) == ("text,s,n", 1, "s", False)


def test_a_folder_is_read_twice_however_its_files_are_dealt(spark, tmp_path):
    import csv

    for i in range(9):
        with open(tmp_path / f"f{i}.csv", "w", newline="") as out:
            # Quoted names may hold commas, quotes and line breaks; rows may too.
            writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if i % 2 else csv.QUOTE_MINIMAL)
            names = ["id", "text", "V", 'odd, "name"\nof two lines']
            order = names if i % 3 else names[::-1]
            writer.writerow(order)
            for j in range(40):
                row = {"id": 100 * i + j, "text": f'line one\nline "{j}", two', "V": j / 2, names[3]: f"x{j}"}
                writer.writerow([row[n] for n in order])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("text,id,,\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for first, second in (("128m", "128m"), ("1k", "128m"), ("128m", "1k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            df = sources.read_annotated(spark, str(tmp_path))
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            found.append(sorted(tuple(r) for r in df.select("id", "text", "V", F.col('`odd, "name"\nof two lines`')).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2] == [(100 * i + j, f'line one\nline "{j}", two', j / 2, f"x{j}") for i in range(9) for j in range(40)]
