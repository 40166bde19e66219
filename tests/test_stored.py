"""Joins of crowded keys, bucketed tables, and counts taken while writing."""

import uuid

import pytest
from pyspark.sql import functions as F

from tonescale import sources
from tonescale.operators import align, metrics, split


@pytest.fixture(scope="module")
def sides(spark):
    """One key in half the rows of one side, missing keys on both."""
    key = F.when(F.col("row") % 2 == 0, F.lit(7)).when(F.col("row") % 11 == 1, F.lit(None)).otherwise(F.col("row") % 3000)
    preds = spark.range(20_000).withColumnRenamed("id", "row").select(key.alias("id"), "row", (F.col("row") / 7.0).alias("V_pred"), F.lit("p").alias("text"))
    few = F.when(F.col("row") % 50 == 0, F.lit(None)).when(F.col("row") < 6, F.lit(7)).otherwise(F.col("row"))
    gold = spark.range(3000).withColumnRenamed("id", "row").select(few.alias("id"), F.col("row").alias("g"), F.lit("g").alias("text"))
    return preds.repartition(4), gold.repartition(3)


@pytest.mark.parametrize("most", [150, 1000, 1_000_000])
def test_spread_rows_are_those_of_the_join(sides, most):
    preds, gold = sides
    plain, spread = align.align(preds, gold, "id"), align.align_spread(preds, gold, "id", most)
    assert spread.columns == plain.columns
    digest = [F.count("*"), F.sum("row"), F.sum("g"), F.sum(F.xxhash64(*plain.columns).cast("decimal(20,0)"))]
    assert spread.agg(*digest).first() == plain.agg(*digest).first()


def test_no_task_has_twice_the_rows_of_the_median(sides, spark):
    preds, gold = sides
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        gold = gold.filter("id IS NOT NULL AND (id <> 7 OR g = 1)")

        def rows_of_tasks(joined):
            return sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())

        plain, spread = rows_of_tasks(align.align(preds, gold, "id")), rows_of_tasks(align.align_spread(preds, gold, "id", 50))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(plain) == sum(spread) and plain[-1] > 4 * plain[len(plain) // 2]
    assert spread[-1] < 2 * spread[len(spread) // 2]


def test_repeated_texts_and_missing_ones_are_spread(spark):
    preds = spark.createDataFrame([("x" if i % 3 else None, float(i)) for i in range(90)], "text string, V_pred double")
    gold = spark.createDataFrame([("x" if i % 2 else None, float(i)) for i in range(8)] + [("y", 9.0)], "text string, V double")
    plain, spread = (sorted(map(tuple, d.collect()), key=str) for d in (align.align(preds, gold), align.align_spread(preds, gold, "text", 4)))
    assert plain == spread and len(plain) == 60 * 4 + 30 * 4
    assert align.align_spread(preds.filter("text = 'z'"), gold, "text", 4).count() == 0


def test_bucketed_tables_are_joined_where_they_lie(spark, tmp_path, sides):
    preds = spark.range(500).select("id", (F.col("id") / 7).alias("V_pred"), (F.col("id") / 5).alias("A_pred"), F.lit(3.0).alias("D_pred"))
    gold = spark.range(100, 600).select("id", (F.col("id") / 6).alias("V"), (F.col("id") / 9).alias("A"), (F.col("id") % 3 / 2).alias("D"))
    name = f"b{uuid.uuid4().hex}"
    p = sources.store_bucketed(preds, f"{name}_p", f"{tmp_path}/p", buckets=4)
    g = sources.store_bucketed(gold, f"{name}_g", f"{tmp_path}/g", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        aligned = align.align(p, g, "id", missing="drop")
        plan = aligned._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in align.align(preds, gold, "id")._jdf.queryExecution().executedPlan().toString()
        spark.sql(f"DROP TABLE {name}_p")
        again = align.align(sources.open_bucketed(spark, f"{name}_p", f"{tmp_path}/p", buckets=4), g, "id", missing="drop")
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted(map(tuple, metrics.evaluate(align.align(preds, gold, "id")).collect()))
    for a, b in zip(sorted(map(tuple, metrics.evaluate(again).collect())), want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    assert again.count() == 400
    for side in "pg":
        spark.sql(f"DROP TABLE {name}_{side}")


def test_missing_keys_can_be_dropped(spark):
    preds = spark.createDataFrame([(1, 1.0), (None, 2.0)], "id long, V_pred double")
    gold = spark.createDataFrame([(1, 3.0), (None, 4.0)], "id long, V double")
    assert align.align(preds, gold).count() == 2 and align.align(preds, gold, missing="drop").count() == 1


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("t").alias("text"), *[F.lit(1.0).alias(d) for d in "VAD"]).repartition(5)
    long = split.to_long(split.split_exact(rows), keep=("id", "split"))
    context = spark.sparkContext
    context.setJobGroup("counted", "one write")
    sizes = sources.write_splits_counted(long, f"{tmp_path}/s")
    context.setLocalProperty("spark.jobGroup.id", None)
    stored = {(r["dim"], r["split"]): r["count"] for r in spark.read.parquet(f"{tmp_path}/s").groupBy("dim", "split").count().collect()}
    assert {(d, s): n for d, s, n in sizes} == stored == {(d, s): n for d in "VAD" for s, n in (("train", 240), ("val", 60))}
    context.setJobGroup("plain", "the same write without counts")
    sources.write_splits(long, f"{tmp_path}/p")
    context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [len(context.statusTracker().getJobIdsForGroup(g)) for g in ("counted", "plain")]
    assert jobs[0] == jobs[1]


def test_aligned_rows_and_what_was_lost(spark, tmp_path):
    preds = spark.createDataFrame([(i if i else None, float(i)) for i in (0, 1, 2, 2, 3)], "id long, V_pred double")
    gold = spark.createDataFrame([(None, 1.0), (2, 2.0), (2, 2.5), (8, 3.0), (9, 4.0)], "id long, V double")
    found = sources.write_aligned(preds, gold, f"{tmp_path}/a")
    assert found == {"n_aligned": 5, "lost_pred": 2, "lost_gold": 2}
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(spark.read.parquet(f"{tmp_path}/a")) == key(align.align(preds, gold))
    cover = align.coverage(preds, gold, "id").first()
    assert (cover.n_aligned, cover.lost_pred, cover.lost_gold) == (5, 2, 2)


def test_an_epoch_is_replaced_and_others_stay(spark, tmp_path):
    path, by = f"{tmp_path}/log", ("run", "epoch")
    log = lambda *rows: spark.createDataFrame(rows, "run string, epoch int, loss double")
    sources.append_losses(log(("a", 1, 0.5), ("b", 1, 0.4)), path, by)
    sources.append_losses(log(("a", 2, 0.3)), path, by)
    sources.append_losses(log(("a", 2, 0.2)), path, by)
    got = spark.read.parquet(path).select("run", F.col("epoch").cast("int"), "loss").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 0.5), ("a", 2, 0.2), ("b", 1, 0.4)]
