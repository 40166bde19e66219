"""The corpus pipeline and the registered queries."""

import pytest

import __spark_entry__
import corpus_pipeline
from tonescale.llm import queries, secrets
from tonescale.llm import rows as rows_of_texts
from tonescale.session import broadcast_if_small

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    clean = [" ".join(f"{c}{i}x" for i in range(60)) for c in "abcd"]
    item = " ".join(f"bench{i}" for i in range(15))
    texts = [clean[0], clean[0], clean[1] + " token = 'abcdef123456789'", "too short", "a b c d " * 30, clean[2] + " " + item, clean[3], None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert kept == [[0, 1, 2, 5, 6], [0, 2, 5, 6], [0, 2, 6], [0, 2, 6], [0, 2, 6]]
    redacted = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/secret_redaction").collect()}
    assert redacted[0]["text"] == clean[0] and not secrets.find(redacted[2]["text"])
    run = {(r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {(r["doc_id"], r["ids_crc32"]) for r in docs.collect()}
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_rows_with_null_and_repeated_ids_are_judged_each_alone(spark, tmp_path):
    texts = [" ".join(f"{c}{i}x" for i in range(60)) for c in "abcde"]
    item = " ".join(f"bench{i}" for i in range(15))
    rows = [(None, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[2]), (2, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r["text"], r["doc_id"]) for r in kept.collect()) == [(texts[0], 1), (texts[1], None), (texts[2], 2), (texts[3], 2)]
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, texts[0]), (None, f"{texts[1]} {item}"), (3, texts[2]), (3, f"{texts[3]} {item}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == {(None, texts[0]), (3, texts[2]), (None, None)}


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_texts_are_not_shuffled_while_few_rows_go(spark, tmp_path, monkeypatch, most):
    texts = [" ".join(f"{c}{i}x" for i in range(60)) for c in "abc"]
    item = " ".join(f"bench{i}" for i in range(15))
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = list(enumerate([*texts, texts[0], f"{texts[1]} {item}"]))
    monkeypatch.setattr(rows_of_texts, "broadcast_if_small", lambda df: broadcast_if_small(df, most))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for stage, want in ((corpus_pipeline.near_duplicates, rows[:3]), (corpus_pipeline.decontamination, rows[:4])):
            got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning" in plan) == (most == 0)
            assert sorted(tuple(r) for r in got.collect() if r["doc_id"] != 4) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(15))
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [" ".join(f"{c}{i}x" for i in range(60)) for c in "abc"]
    names = ["_row", "row", "__ROW", "key", "id", "spans", "fp", "n_words", "run", "nth", "items"]
    rows = [(i, t, *[f"{n} {i}" for n in names]) for i, t in enumerate([*texts, texts[0], f"{texts[1]} {item} more"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *names]
    assert sorted(tuple(r) for r in docs.collect()) == rows[:3]


def test_every_operator_is_registered():
    known = __spark_entry__.queries()
    assert "pipeline" in known
    assert [sum(q.startswith(f"op{n}_") for q in known) for n in range(1, 14)] == [1] * 13
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(queries.QUERIES) == 13
