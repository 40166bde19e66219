"""Fingerprints of texts by winnowing: the least hash of every window of consecutive k-grams, with its place.

A rolling hash gives each run of ``GRAM`` code points a number; of every ``WINDOW`` consecutive ones the least is kept, the
rightmost of equal ones. Two texts that share ``GUARANTEE`` = ``WINDOW`` + ``GRAM`` - 1 consecutive code points therefore share
a kept hash whose two places lie at the same point of the passage. Neighbouring kept places are never more than a
window apart, so a place is stored as its distance from the one before, in one byte.

Hashes come from one running sum over the code points (a polynomial modulo 2^64), and minima of windows by
doubling, for many texts at once; a text longer than ``CHUNK`` is worked on in overlapping stretches, so memory does not grow
with it. A text with fewer k-grams than a window is one window; a shorter one than a k-gram is one gram.

Defined results: null texts count as empty; an empty text has no hashes, its fingerprint is the empty string, and two
such fingerprints are alike (1). Documents follow each other by id, descending, null ids last, equal ids by a hash of the text;
documents equal in both follow each other in any order, as they are the same but for other columns. The last is followed by the first, a single one by itself.
Repeated documents each get a row, an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.llm.text import gather, pieces, strings

GRAM = 20
WINDOW = 48
GUARANTEE = WINDOW + GRAM - 1
#: Code points that are worked on at once.
CHUNK = 1 << 20
#: Stretches of the order of documents per shuffle partition, documents looked at for each, and stretches at most.
_STRETCHES, _LOOKED_AT, _MOST = 4, 8, 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_DIGITS = 10


@cache
def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The upper half of the hashes after their bits were spread."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(32)


def _hashes(codes: np.ndarray, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """32-bit hashes of the grams that begin at ``starts``."""
    most = CHUNK + GUARANTEE
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(_INVERSE, most)[: len(codes)], out=sums[1:])
    return _mixed((sums[starts + length] - sums[starts]) * _powers(_BASE, most)[starts])


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` consecutive keys, by doubling."""
    span = 1
    while 2 * span <= window:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (window - span)], keys[window - span :]) if window > span else keys


def _chosen(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(places, hashes)`` that the windows keep, text after text; places are in the whole run of code points."""
    codes = codes.astype(np.uint64)
    begins = np.concatenate([[0], ends[:-1]])
    size = ends - begins
    grams = np.where(size > 0, np.maximum(size - GRAM + 1, 1), 0)
    starts = gather(begins, grams)
    short = np.repeat(size < GRAM, grams)
    hashes = _hashes(codes, starts, np.where(short, np.repeat(size, grams), GRAM))
    # Least hash first, then the rightmost place.
    places = np.arange(len(starts), dtype=np.uint64)
    keys = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - places)
    stops = np.cumsum(grams)
    firsts = stops - grams
    full = grams >= WINDOW
    windows = np.zeros(0, np.uint64)
    if full.any():
        windows = _least(keys, WINDOW)[gather(firsts[full], grams[full] - WINDOW + 1)]
    few = (grams > 0) & ~full
    if few.any():
        inside = gather(firsts[few], grams[few])
        cuts = np.cumsum(grams[few]) - grams[few]
        windows = np.concatenate([windows, np.minimum.reduceat(keys[inside], cuts)])
    marked = np.zeros(len(starts), bool)
    marked[(np.uint64(0xFFFFFFFF) - (windows & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
    kept = np.flatnonzero(marked)
    return starts[kept], hashes[kept].astype(np.uint32)


def winnowed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(of, places, hashes)``: the kept k-grams of all texts, the number of the text, its place there and its hash."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
    run, size = [], 0

    def add(numbers: list[int]) -> None:
        codes = np.frombuffer("".join(texts[i] for i in numbers).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(texts[i]) for i in numbers])
        places, hashes = _chosen(codes, ends)
        which = np.searchsorted(ends, places, side="right")
        found.append((np.array(numbers)[which], places - np.concatenate([[0], ends[:-1]])[which], hashes))

    for i, text in enumerate(texts):
        if size + len(text) > CHUNK and run:
            add(run)
            run, size = [], 0
        if len(text) <= max(CHUNK, GUARANTEE):
            run.append(i)
            size += len(text)
            continue
        # Every window lies in one of the stretches; those that lie in two keep the same gram.
        parts = []
        for at in range(0, len(text) - GUARANTEE + 1, CHUNK):
            codes = np.frombuffer(text[at : at + CHUNK + GUARANTEE - 1].encode("utf-32-le"), "<u4")
            places, hashes = _chosen(codes, np.array([len(codes)]))
            parts.append((places + at, hashes))
        places, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
        found.append((np.full(len(places), i), places, np.concatenate([h for _, h in parts])[first]))
    if run:
        add(run)
    return tuple(np.concatenate(x) for x in zip(*found))


def _rendered(of: np.ndarray, places: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
    """Ten hex digits for each kept k-gram of a text: two for its distance from the one before, eight for its hash."""
    gaps = np.diff(places, prepend=0)
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    gaps[first] = places[first]
    raw = np.zeros((len(of), 5), np.uint8)
    raw[:, 0] = gaps
    raw[:, 1:] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    return strings(np.frombuffer(raw.tobytes().hex().encode(), np.uint8), np.bincount(of, minlength=n) * _DIGITS)


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """``(places, hashes)`` of a fingerprint."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.cumsum(raw[:, 0].astype(np.int64)), raw[:, 1:].copy().view(">u4").ravel().astype(np.uint32)


def shared(a: str, b: str) -> list[tuple[int, int]]:
    """Places in two fingerprinted texts with the same kept k-gram. Each common passage of ``GUARANTEE`` code points or more has one."""
    (places_a, hashes_a), (places_b, hashes_b) = parsed(a), parsed(b)
    order = np.argsort(hashes_b, kind="stable")
    low, high = (np.searchsorted(hashes_b[order], hashes_a, side=s) for s in ("left", "right"))
    at = order[gather(low, high - low)]
    return list(zip(np.repeat(places_a, high - low).tolist(), places_b[at].tolist()))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_column, n_chars, fingerprint)`` of every document."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, CHUNK):
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), _rendered(*winnowed(texts), len(texts))]
            yield pa.record_batch(columns, ["id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_column)


def _likeness(a, b, n: int, shift: int = 0) -> np.ndarray:
    """Of the distinct hashes of texts i of ``a`` and i + shift of ``b``, how many of all are in both, for n texts."""
    (of_a, _, hash_a), (of_b, _, hash_b) = a, b
    one = np.unique(of_a[of_a < n].astype(np.uint64) << np.uint64(32) | hash_a[of_a < n])
    inside = (of_b >= shift) & (of_b < n + shift)
    two = np.unique((of_b[inside] - shift).astype(np.uint64) << np.uint64(32) | hash_b[inside])
    both = np.intersect1d(one, two, assume_unique=True)
    count = [np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n) for x in (one, two, both)]
    union = count[0] + count[1] - count[2]
    return np.where(union > 0, count[2] / np.maximum(union, 1), 1.0)


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows (id, text)`` dealt out by their order: ``(stretch, ahead, id, text)``, sorted within partitions.

    Stretches are cut at keys of documents, those of the smallest hashes, so they are of about even size whatever the
    ids look like, and a document that begins one is known by its key. It is dealt out twice: into its own stretch,
    and marked ``ahead`` to the end of the one before, as the next document of the last there. The first follows the
    last. Texts are shuffled once; the cuts alone, at most ``_MOST`` keys, pass through the driver.
    """
    wanted = min(_MOST, _STRETCHES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Larger keys come first; two null ids are equal, and a null id is smaller than all others.
    key = [F.col("id").isNotNull().alias("known"), F.col("id"), F.bitwise_not(F.xxhash64("text")).alias("hash")]
    keys = rows.select(*key)
    top = keys.orderBy(*[F.desc(c) for c in keys.columns]).limit(1).collect()
    looked_at = keys.orderBy(F.xxhash64("hash", F.col("id").cast("string"))).limit(wanted * _LOOKED_AT).collect()
    cuts = sorted({tuple(k) for k in top} | set(sorted({tuple(k) for k in looked_at})[::_LOOKED_AT]))

    @F.arrow_udf("stretch long, begins boolean")
    def place(known: pa.Array, ids: pa.Array, hashes: pa.Array) -> pa.Array:
        found = list(zip(known.to_pylist(), ids.to_pylist(), hashes.to_pylist()))
        at = [bisect_left(cuts, k) for k in found]
        begins = [cuts[i] == k for i, k in zip(at, found)]
        return pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(begins, pa.bool_())], ["stretch", "begins"])

    own, before = F.col("place.stretch"), (F.col("place.stretch") + 1) % len(cuts) if cuts else F.lit(0).cast("long")
    places = [F.struct(own.alias("stretch"), F.lit(False).alias("ahead")), F.struct(before.alias("stretch"), F.lit(True).alias("ahead"))]
    spread = F.explode(F.when(F.col("place.begins"), F.array(*places)).otherwise(F.array(places[0])))
    dealt = rows.withColumn("place", place(*key)).select(spread.alias("to"), "id", "text").select("to.stretch", "to.ahead", "id", "text")
    order = ["stretch", "ahead", F.desc_nulls_last("id"), F.xxhash64("text")]
    return dealt.repartition("stretch").sortWithinPartitions(*order)


def compare_edited(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_column, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every document.

    The edited text has the second half of the code points replaced by as many (or all) of the first ones of the
    next document, by descending id. ``near_edited`` and ``near_next`` are the shares of common hashes
    with the edited text and with the next document.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type: list[pa.DataType] = []

    def compared(held: list[tuple], following: str) -> pa.RecordBatch:
        texts, n = [t for _, t in held] + [following], len(held)
        edited = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i, t in enumerate(texts[:-1])]
        own, other = winnowed(texts), winnowed(edited)
        here = own[0] < n
        columns = [
            pa.array([i for i, _ in held], id_type[0]),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            _rendered(*(x[here] for x in own), n),
            _rendered(*other, n),
            pa.array(_likeness(own, other, n)),
            pa.array(_likeness(own, own, n, shift=1)),
        ]
        return pa.record_batch(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, stretch, done = 0, None, False
        for batch in pieces(batches, 3, CHUNK):
            id_type[:] = [batch.column(2).type]
            for to, ahead, i, value in zip(*(c.to_pylist() for c in batch.columns)):
                if to != stretch:
                    stretch, done = to, False
                if ahead:
                    if not done:
                        yield compared(held, value)
                    held, size, done = [], 0, True
                    continue
                if size >= CHUNK:
                    yield compared(held, value)
                    held, size = [], 0
                held.append((i, value))
                size += len(value)

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(rows).mapInArrow(run, schema).withColumnRenamed("id", id_column)
