"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that, of two fingerprints within the
distance, one segment differs in at most one bit. With distance 4 these are three segments. Every
segment is indexed once for each of its bits with that bit deleted (the wildcard), so fingerprints
that differ nowhere else in the segment meet under an equal key; the join verifies the whole
distance and emits a link under one key only.

Equal fingerprints become one node first, so copies cost nothing. Dense groups of near copies
are contracted before candidates are formed: each fingerprint is compared with the smallest one of each
of its whole segments, and groups of more than ``CROWD`` that this connects are not compared
within themselves again. That changes no component: such links add nothing to what is connected.

Defined results: a null or empty text, and one without words, has fingerprint zero and is linked like any
other. Repeated rows and rows with a null id each get their own row; a null id is never a component's id, and a
component without any other id has a null one. Other columns of the input are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescale.llm.links import components
from tonescale.llm.text import SPACE_CUT_LOWER, cut_words, gather, pieces, strings, text_bytes, texts_of
from tonescale.llm.rows import numbered, without
from tonescale.session import materialize

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Groups of near copies of more fingerprints than this are not compared within themselves twice.
CROWD = 64
_CHUNK = 1 << 16
# Text of which a task holds all shingle hashes at once.
_TEXT = 3 << 20


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """``(shift, width)`` of as few segments as leave one of them at most one differing bit."""
    n = distance // 2 + 1
    ends = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and how many each text has."""
    words, ends = cut_words(texts, SPACE_CUT_LOWER)
    counts = np.diff(ends, prepend=0)
    data, offsets = text_bytes(words)
    # The words with one space after each.
    spaced = np.full(len(data) + len(words), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = data
    starts = offsets[:-1] + np.arange(len(words))
    stops = offsets[1:] + np.arange(len(words))
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = gather(ends - counts, n)
    last = first + np.repeat(np.minimum(counts, size), n) - 1
    buffer, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    found = [digest(buffer[a:b], SEED) for a, b in zip(starts[first].tolist(), stops[last].tolist())]
    return np.array(found, np.uint64), n


def fingerprints_of(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """One signed 64-bit fingerprint per text: a bit is set where over half of the shingle hashes set it."""
    hashes, n = _shingle_hashes(texts, size)
    row = np.repeat(np.arange(len(n)), n)
    ones = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part, rows = hashes[at : at + _CHUNK], row[at : at + _CHUNK]
        # Runs of at most 255 hashes of one text: then eight sums fit into the bytes of one number.
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        runs = -(-np.diff(first, append=len(rows)) // 255)
        run = np.repeat(first, runs) + 255 * gather(np.zeros(len(runs), np.int64), runs)
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & np.uint64(0x0101010101010101), run)
            np.add.at(ones, (rows[run][:, None], bit + 8 * np.arange(8)), sums.view(np.uint8).reshape(-1, 8))
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").reshape(-1).view(np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id_column, fp)``."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in pieces(batches, 1, _TEXT):
            found = fingerprints_of(texts_of(batch.column(1)), size)
            yield pa.record_batch([batch.column(0), pa.array(found)], ["id", "fp"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")
    return found.withColumnRenamed("id", id_column)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _segment(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _variants(parts: Sequence[tuple[int, int]]) -> Column:
    """All keys of ``fp``: segment number, deleted bit, and the rest of the segment."""
    keys = []
    for s, (shift, width) in enumerate(parts):
        value = _segment(F.col("fp"), shift, width)
        for bit in range(width):
            rest = F.shiftleft(F.shiftright(value, bit + 1), bit).bitwiseOR(value.bitwiseAND(F.lit((1 << bit) - 1)))
            keys.append(rest.bitwiseOR(F.lit((s * 64 + bit) << 48)))
    return F.explode(F.array(*keys))


def _first_meeting(parts: Sequence[tuple[int, int]]) -> Column:
    """Of the keys that ``fp`` and ``fp2`` share, true for one: the first close segment, its differing bit or else bit 0."""
    tag = F.shiftright("key", 48)
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    chosen, before = F.lit(False), F.lit(True)
    for s, (shift, width) in enumerate(parts):
        n = F.bit_count(_segment(differ, shift, width))
        at = (n == 1) & (F.shiftright(tag, 6) == s) | (n == 0) & (tag == s * 64)
        chosen = chosen | before & at
        before = before & (n > 1)
    return chosen


def _merged(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that sorts and merges. Spark takes exploded rows for as few as before, and files for as large as their rows,
    so joins by size would send some hundred times the threshold through the driver."""
    return rows.hint("merge")


def links(nodes: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that connect all that are within ``distance``."""
    parts = segments(distance)
    if max(width for _, width in parts) > 47:
        raise ValueError("the distance leaves segments that are too wide for a key")
    # Contract dense groups: compare with the smallest fingerprint that has an equal segment.
    whole = [_segment(F.col("fp"), *p).bitwiseOR(F.lit(s << 58)) for s, p in enumerate(parts)]
    equal = nodes.select("fp", F.explode(F.array(*whole)).alias("key"))
    hubs = equal.groupBy("key").agg(F.min("fp").alias("fp2"))
    near = (F.col("fp") != F.col("fp2")) & (_distance("fp", "fp2") <= distance)
    stars = materialize(equal.join(_merged(hubs), "key").filter(near).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct(), "stars")
    roots = components(stars)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    crowded = materialize(roots.join(sizes, "root").select(F.col("node").alias("fp"), "root"), "crowded")

    # One side without the crowded fingerprints: pairs of them are never looked at here.
    plain = nodes.join(_merged(crowded), "fp", "left_anti").select("fp", _variants(parts).alias("key"))
    marked = nodes.join(_merged(crowded.select("fp", F.lit(True).alias("crowded"))), "fp", "left")
    others = marked.select(F.col("fp").alias("fp2"), "crowded", "fp")
    others = others.select("fp2", F.coalesce("crowded", F.lit(False)).alias("crowded"), _variants(parts).alias("key"))
    once = F.col("crowded") | (F.col("fp") < F.col("fp2"))
    found = plain.join(
        _merged(others.withColumnRenamed("key", "key2")),
        (F.col("key") == F.col("key2")) & once & (F.col("fp") != F.col("fp2")) & (_distance("fp", "fp2") <= distance) & _first_meeting(parts),
    ).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    # Links between two crowded groups that share a key.
    keyed = crowded.select("fp", "root", _variants(parts).alias("key"))
    meet = keyed.select("key", "root").distinct()
    two = meet.alias("m").join(_merged(meet.withColumnRenamed("root", "root2").alias("o")), "key").filter("root < root2")
    left = two.join(_merged(keyed), ["key", "root"]).select("key", "root2", "fp")
    right = keyed.select("key", F.col("root").alias("root2"), F.col("fp").alias("fp2"))
    between = left.join(_merged(right), ["key", "root2"]).filter((_distance("fp", "fp2") <= distance) & _first_meeting(parts))
    return stars.unionByName(found).unionByName(between.select(F.col("fp").alias("a"), F.col("fp2").alias("b")))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``(id_column, fp, component_id)``: fingerprint, and the smallest id that links lead to."""
    prints = materialize(fingerprints(docs, id_column, text, size), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_column).alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    joined = nodes.join(_merged(roots), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    of = joined.join(lows, "root").select("fp", "component_id")
    return prints.join(_merged(of), "fp").select(id_column, "fp", "component_id")


def hexed(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one row of each component: that of the smallest id, or one with a null id where no row has another.

    Each row is judged by a key of its own, so neither repeated nor null ids keep copies.
    """
    rows, row = numbered(docs, "dedup")
    # Null ids come last.
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col(row).alias("row"))
    groups = near_duplicates(rows.select(key.alias("key"), F.col(text).alias("text")), "key", "text")
    drop = groups.filter(~F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.row").alias(row))
    return without(rows, drop, row).select(*docs.columns)
