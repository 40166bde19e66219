"""Vocabulary and fixed-length token sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescale.functions import tokens
from tonescale.operators.position import with_position
from tonescale.session import materialize

# Ids of padding, unknown token, sequence start and sequence end.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_ID = 4

# Rows that are looked up together.
BLOCK = 1024


def count_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocab(df: DataFrame, text: str = "text", min_count: int = 1, max_size: int | None = None) -> DataFrame:
    """``(token, token_id, n)``; ids grow as counts fall, ties in token order.

    Counting combines on the map side, so frequent tokens cost no more than rare
    ones, and ranking is a range sort: the vocabulary may be of any size.
    """
    counted = count_tokens(df, text)
    if min_count > 1:
        counted = counted.filter(F.col("n") >= min_count)
    if max_size is not None:
        counted = counted.orderBy(F.desc("n"), "token").limit(max_size)
    ranked = with_position(counted, [F.desc("n"), F.asc("token")])
    token_id = F.col("pos") + F.lit(FIRST_ID - 1)
    return ranked.select("token", token_id.cast("int").alias("token_id"), "n")


def _sequence(ids: Column, max_len: int, special: bool) -> list[Column]:
    """Pad to ``max_len`` and mark what is no padding."""
    if special:
        ids = F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)))
    used = F.size(ids)
    unused = F.lit(max_len) - used
    padded = F.concat(ids, F.array_repeat(F.lit(PAD), unused))
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), unused))
    known = ids.isNotNull()
    return [F.when(known, padded).alias("input_ids"), F.when(known, mask).alias("attention_mask")]


def _look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
    """Replace the tokens of one block by their ids; ``known`` has those of its distinct tokens."""
    lists = rows["tokens"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.chunked_array(lists.chunks or [pa.array([], lists.type)]).chunk(0)
    flat = lists.flatten()
    words = known["token"].combine_chunks().cast(flat.type)
    found = pc.take(known["token_id"].combine_chunks(), pc.index_in(flat, value_set=words))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pc.fill_null(found, UNK).cast(pa.int32()), mask=pc.is_null(lists))
    return pa.table({"key": rows["key"], "ids": ids})


def _ids_of(df: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Token ids of every row, whatever the size of the vocabulary and however often a key or token occurs.

    Rows are taken in blocks of ``BLOCK``. The distinct tokens of a block meet the vocabulary once,
    in a join for which Spark chooses the way, so a token that is everywhere costs one row per block; then each
    block is looked up with the ids it needs and nothing else.
    """
    # The cut token lists are small next to the texts; stored, a row's block cannot change.
    numbered = df.select(F.col(key).alias("key"), "tokens", F.monotonically_increasing_id().alias("row"))
    rows = materialize(numbered.select("key", "tokens", F.floor(F.col("row") / BLOCK).alias("block")), "tokens")
    needed = rows.select("block", F.explode("tokens").alias("token")).distinct()
    ids = vocab.select("token", "token_id")
    known = needed.join(ids, "token").select(F.col("block").alias("of"), "token", F.col("token_id").cast("int").alias("token_id"))
    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_look_up, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
    )


def encode_sequences(
    df: DataFrame,
    vocab: DataFrame,
    max_len: int = 64,
    key: str = "id",
    text: str = "text",
    special: bool = True,
) -> DataFrame:
    """``(key, input_ids, attention_mask)``, both arrays exactly ``max_len`` long, one row per row of ``df``.

    The text is tokenized as a whole; the token sequence is then cut so that it fits
    with the start and end marks (``special``). NULL texts give NULL arrays. Keys are carried
    along and may repeat or be NULL.
    """
    room = max_len - 2 if special else max_len
    if room < 1:
        raise ValueError(f"max_len {max_len} leaves no room for tokens")
    cut = df.select(key, F.slice(tokens(text), 1, room).alias("tokens"))
    return _ids_of(cut, vocab, key).select(key, *_sequence(F.col("ids"), max_len, special))
