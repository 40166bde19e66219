from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonescale.operators import encode

TEXTS = ["b a c a", "a\tb\n\nd  a", "", None, "   ", "zzz a a a a a a a a a a a", "c"]


def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def ranked():
    counts = Counter(t for text in TEXTS if text for t in text.split())
    order = sorted(counts, key=lambda t: (-counts[t], t))
    return {t: i + encode.FIRST_ID for i, t in enumerate(order)}


def expected(text, vocab, max_len, special):
    if text is None:
        return None, None
    room = max_len - 2 if special else max_len
    ids = [vocab.get(t, encode.UNK) for t in text.split()][:room]
    if special:
        ids = [encode.CLS, *ids, encode.SEP]
    return ids + [encode.PAD] * (max_len - len(ids)), [1] * len(ids) + [0] * (max_len - len(ids))


def test_vocabulary_order(spark):
    got = {r.token: r.token_id for r in encode.build_vocab(corpus(spark)).collect()}
    assert got == ranked()


def test_vocabulary_limits(spark):
    assert {r.token for r in encode.build_vocab(corpus(spark), max_size=2).collect()} == {"a", "b"}
    assert {r.token for r in encode.build_vocab(corpus(spark), min_count=2).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("max_len", [3, 6, 16])
@pytest.mark.parametrize("block", [encode.BLOCK, 1])
def test_sequences(spark, special, max_len, block, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK", block)
    vocab = {t: i for t, i in ranked().items() if t != "d"}
    table = spark.createDataFrame(list(vocab.items()), "token string, token_id int")
    rows = encode.encode_sequences(corpus(spark), table, max_len, special=special).collect()
    got = {r.id: (r.input_ids, r.attention_mask) for r in rows}
    assert got == {i: expected(t, vocab, max_len, special) for i, t in enumerate(TEXTS)}


def test_keys_may_repeat_or_be_missing(spark):
    """Rows stay rows of their own, however large the vocabulary is."""
    df = spark.createDataFrame([(1, "a b"), (1, "b b"), (None, "a"), (None, None), (2, "")], "id long, text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, token_id int")
    got = sorted(((r.id, r.input_ids) for r in encode.encode_sequences(df, vocab, 4).collect()), key=str)
    want = [(1, [2, 4, 5, 3]), (1, [2, 5, 5, 3]), (None, [2, 4, 3, 0]), (None, None), (2, [2, 3, 0, 0])]
    assert got == sorted(want, key=str)
    assert encode.encode_sequences(df.limit(0), vocab, 4).count() == 0
    assert [r.input_ids for r in encode.encode_sequences(df.limit(1), vocab.limit(0), 4).collect()] == [[2, 1, 1, 3]]


@pytest.mark.parametrize("hot", ["known", "unknown"])
def test_a_hot_token(spark, hot):
    """One token makes up most of the text; with or without an entry in the vocabulary."""
    df = spark.range(400).select("id", F.concat(F.repeat(F.lit(f"{hot} "), 20), F.lit("w"), F.col("id")).alias("text"))
    vocab = spark.range(390).select(
        F.concat(F.lit("w"), F.col("id")).alias("token"), (F.col("id") + 10).cast("int").alias("token_id")
    ).unionAll(spark.createDataFrame([("known", 4)], "token string, token_id int"))
    rows = encode.encode_sequences(df, vocab, 32).orderBy("id").collect()
    own = 4 if hot == "known" else encode.UNK
    for i, r in enumerate(rows):
        assert r.input_ids[1:22] == [own] * 20 + [i + 10 if i < 390 else encode.UNK]


def test_no_room(spark):
    with pytest.raises(ValueError, match="room"):
        encode.encode_sequences(corpus(spark), spark.createDataFrame([("a", 4)], "token string, token_id int"), 2)
