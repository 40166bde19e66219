import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescale.operators import position, split


def digest(seed, key):
    return hashlib.md5(f"{seed}-{key}".encode()).hexdigest()


@pytest.mark.parametrize("rule", split.RULES)
def test_sizes_for_small_tables(spark, rule):
    for n in range(0, 21):
        cut = split.find_cut(spark.range(n), rule=rule)
        want = round(0.8 * n) if rule == "round" else n - math.ceil(0.2 * n)
        assert (cut.n, cut.n_train) == (n, want if n else 0)


@pytest.mark.parametrize("rule", split.RULES)
def test_membership_follows_the_hash_order(spark, rule):
    n = 503
    keys = sorted(range(n), key=lambda k: digest(7, k))
    n_train = round(0.8 * n) if rule == "round" else n - math.ceil(0.2 * n)
    parts = split.split_exact(spark.range(n), seed=7, rule=rule)
    train = {r.id for r in parts.filter("split = 'train'").collect()}
    assert train == set(keys[:n_train])
    assert parts.filter("split = 'val'").count() == n - n_train


def test_split_does_not_depend_on_partitions(spark):
    a = split.find_cut(spark.range(1000).repartition(1))
    b = split.find_cut(spark.range(1000).repartition(13, F.rand(1)))
    assert a == b


def test_text_keys_and_other_fractions(spark):
    df = spark.range(101).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    for fraction in (0.0, 0.25, 0.5, 1.0):
        parts = split.split_exact(df, "key", fraction)
        assert parts.filter("split = 'train'").count() == round(fraction * 101)


def test_applying_a_cut_shuffles_nothing(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = split.split_exact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_hot_duplicate_key_at_the_cut_is_refused(spark):
    hot = spark.range(1000).select(F.when(F.col("id") < 900, F.lit(1)).otherwise(F.col("id")).alias("id"))
    with pytest.raises(ValueError, match="not unique"):
        split.find_cut(hot, fraction=0.5)


def test_null_keys_are_refused(spark):
    with pytest.raises(ValueError, match="NULL"):
        split.find_cut(spark.createDataFrame([(1,), (None,), (3,)], "id long"))


def test_complement(spark):
    rest = split.complement(spark.range(10), spark.range(4))
    assert sorted(r.id for r in rest.collect()) == [4, 5, 6, 7, 8, 9]


def test_positions_by_any_order(spark):
    rng = np.random.default_rng(0)
    values = [float(v) for v in rng.permutation(997)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(7)
    for order, reverse in (([F.asc("v")], False), ([F.desc("v")], True)):
        got = {r.id: r.pos for r in position.with_position(df, order).collect()}
        ranked = sorted(range(997), key=lambda i: values[i], reverse=reverse)
        assert got == {i: at + 1 for at, i in enumerate(ranked)}


def test_positions_with_a_hot_key(spark):
    """A third of the rows share a key: positions are still 1..n and sorted by it."""
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.lit(500)).otherwise(F.col("id")).alias("k"))
    rows = position.with_position(df, ["k", "id"]).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 3001))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


def test_positions_of_an_empty_table(spark):
    assert position.with_position(spark.range(0), ["id"]).count() == 0


def test_shuffled_positions(spark):
    got = {r.id: r.pos for r in position.shuffled_position(spark.range(500), "id", 42, 3).collect()}
    ranked = sorted(range(500), key=lambda k: hashlib.md5(f"42-3-{k}".encode()).hexdigest())
    assert got == {k: at + 1 for at, k in enumerate(ranked)}
    other = {r.id: r.pos for r in position.shuffled_position(spark.range(500), "id", 42, 4).collect()}
    assert other != got


def test_batches(spark):
    rows = spark.range(1, 34).select(position.batch_of("id").alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [(r.b, r["count"]) for r in rows] == [(0, 16), (1, 16), (2, 1)]


def test_long_form(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0, 3.0)], "id long, text string, V double, A double, D double")
    rows = {r.dim: r.value for r in split.to_long(df).collect()}
    assert rows == {"V": 1.0, "A": 2.0, "D": 3.0}


def test_scratch_tables_are_removed_on_request(spark):
    from tonescale import session

    kept = position.with_position(spark.range(5), ["id"])
    assert kept.count() == 5
    path = session._made[spark.sparkContext.applicationId][-1]
    assert os.path.isdir(path)
    assert session.clear_scratch(spark) >= 1 and not os.path.exists(path)


@pytest.mark.parametrize("rule", split.RULES)
@pytest.mark.parametrize("digits, few", [(1, 1), (1, 40), (2, 3), (4, 10_000), (5, 0)])
def test_levels_of_any_width_find_the_same_cut(spark, rule, digits, few):
    df = spark.range(700)
    assert split.find_cut(df, rule=rule, digits=digits, few=few) == split.find_cut(df, rule=rule)
    with pytest.raises(ValueError, match="not unique"):
        split.find_cut(df.unionAll(df).filter("id < 350").select((F.col("id") * 0).alias("id")), rule=rule, digits=digits, few=few)
    with pytest.raises(ValueError, match="NULL"):
        split.find_cut(df.select(F.when(F.col("id") > 3, F.col("id")).alias("id")), rule=rule, digits=digits, few=few)


def test_keys_of_a_join_are_made_once(spark, tmp_path):
    spark.range(300).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    joined = a.join(a.withColumn("x", F.col("id") % 2), "id")
    assert split._is_plain(a.filter("id > 4").select("id")) and not split._is_plain(joined.select("id"))
    assert split.find_cut(joined) == split.find_cut(a)


def test_equal_order_keys_are_spread_over_tasks(spark):
    df = spark.range(20_000).select("id", F.lit("same").alias("k"), F.create_map(F.lit("a"), "id").alias("m"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = position.with_position(df, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert placed.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()[:] == (1, 20_000, 20_000)
    files = [r["count"] for r in placed.groupBy(F.input_file_name()).count().collect()]
    assert len(files) == 8 and max(files) < 2 * sorted(files)[4]
    again = {r.id: r.pos for r in position.with_position(df.repartition(3), ["k"]).collect()}
    assert again == {r.id: r.pos for r in placed.collect()}
