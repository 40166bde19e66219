"""Vectors as short codes: each part of a vector is the number of the nearest entry of its part's codebook.

Nearest entries are found by equal-average search. By the Cauchy-Schwarz inequality the squared distance of two
vectors of length d is at least the squared difference of their component sums over d. The entries of a codebook are
sorted by their sums; from a part's own sum the search goes outward on both sides, and a side is done once
its squared gap over d strictly exceeds the best distance so far, so entries at exactly that distance are still seen.

Codebooks have a fixed size; only they, and one sum per entry and component, pass through the driver. Vectors stay
in tables: their integers are stored once, and each round is one pass over them.

Defined results: vectors that are null, or that have null or non-finite components, are dropped. So are those
whose length is not the most frequent one (of equally frequent ones the longest) among the non-empty lengths that can be cut into equal parts.
Components beyond ``LIMIT`` over the length of a part are held at it. With fewer vectors than entries each vector is an entry. Repeated
vectors each get a row; vectors of equal ids are taken as entries in the order of their integers, null ids last. Null
labels are one label; a sum beyond 63 bits is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.llm.text import strings
from tonescale.session import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 27
#: So many different labels are joined by broadcast; of more, only those that are frequent.
SMALL = 100_000
_FREQUENT = 1_000


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each point, the lower one of equally near ones, and its squared distance."""
    size, width = entries.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    entries, sums = entries[order], sums[order]
    own = points.sum(axis=1)
    best = np.full(len(points), np.iinfo(np.int64).max // (2 * width))
    chosen = np.full(len(points), size)
    right = np.searchsorted(sums, own)
    sides = [(np.arange(len(points)), right, 1), (np.arange(len(points)), right - 1, -1)]
    while sides:
        going = []
        for rows, at, step in sides:
            inside = (at >= 0) & (at < size)
            rows, at = rows[inside], at[inside]
            gap = own[rows] - sums[at]
            near = gap * gap <= best[rows] * width
            rows, at = rows[near], at[near]
            if not len(rows):
                continue
            distance = ((points[rows] - entries[at]) ** 2).sum(axis=1)
            number = order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = distance[better], number[better]
            going.append((rows, at + step, step))
        sides = going
    return chosen, best


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """``(id, label, x)`` of the usable vectors, ``x`` as integers, in a scratch table; and their length, 0 if there are none."""
    infinite = F.lit(float("inf"))
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < infinite))
    whole = F.transform(
        F.col(vector).cast("array<double>"),
        # Cast only what fits; the exact bound depends on the length, which is known later.
        lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("long"),
    )
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), vector).filter(usable)
    stored = materialize(rows.select("id", "label", whole.alias("x")), "vectors")
    lengths = stored.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
    cut = lengths.filter((F.col("length") > 0) & (F.col("length") % parts == 0))
    most = cut.orderBy(F.desc("n"), F.desc("length")).first()
    length = most["length"] if most else 0
    most_allowed = F.lit(LIMIT // max(1, length // parts)).cast("long")
    held = F.transform("x", lambda v: F.least(F.greatest(v, -most_allowed), most_allowed))
    return stored.filter(F.size("x") == length).withColumn("x", held), length


def _cut(column: pa.Array, parts: int, length: int) -> np.ndarray:
    """Vectors as a (rows, parts, components) array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, length // parts)


def first_books(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, components): the parts of the vectors of the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(-1, parts, length // parts).swapaxes(0, 1)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry becomes the mean, rounded down, of the parts it is nearest to."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _cut(batch.column(0), parts, parts * width)
                for p in range(parts):
                    chosen, _ = nearest(x[:, p], books[p])
                    np.add.at(total[p, :, :width], chosen, x[:, p])
                    total[p, :, width] += np.bincount(chosen, minlength=entries)
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    found = rows.select("x").mapInArrow(sums, "cell long, value long").groupBy("cell").agg(F.sum("value")).collect()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for cell, value in found:
        total[cell] = value
    total = total.reshape(parts, entries, width + 1)
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)


def fit(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components) of the rows of ``integers``."""
    books = first_books(rows, length, parts, entries)
    for _ in range(rounds):
        books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``(id, label, code, error)``: two hex digits for each part, and the squared distance to the vector that the code stands for."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _cut(batch.column(2), parts, parts * width)
            code, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                chosen, distance = nearest(x[:, p], books[p])
                code[:, p] = chosen
                error += distance
            digits = np.frombuffer(code.tobytes().hex().encode(), np.uint8)
            codes = strings(digits, np.full(len(x), 2 * parts))
            yield pa.record_batch([batch.column(0), batch.column(1), codes, pa.array(error)], ["id", "label", "code", "error"])

    return rows.select("id", "label", "x").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """Adds ``vector``, the middle of the cell of each component that a code stands for."""
    parts, _, width = books.shape
    values = (books + 0.5) / scale

    @F.arrow_udf("array<double>")
    def vector(column: pa.Array) -> pa.Array:
        known = [c for c in column.to_pylist() if c is not None]
        numbers = np.frombuffer(bytes.fromhex("".join(known)), np.uint8).reshape(-1, parts)
        found = iter(values[np.arange(parts), numbers].reshape(-1, parts * width).tolist())
        return pa.array([None if c is None else next(found) for c in column.to_pylist()], pa.list_(pa.float64()))

    return codes.withColumn("vector", vector(code))


def with_label_errors(coded: DataFrame, small: int = SMALL) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over the rows of the same label.

    The sums, one row per label, are counted before they are broadcast. Of more than ``small`` labels only those with
    over a thousandth of the rows are, at most a thousand, so that no label's rows meet in one task.
    """
    sums = materialize(
        coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "labels"
    )
    same = F.col("label").eqNullSafe(F.col("of"))
    labels, total = sums.agg(F.count("*"), F.sum("n")).first()
    if labels <= small:
        return coded.join(F.broadcast(sums), same).drop("of", "n")
    frequent = sums.filter(F.col("n") > total // _FREQUENT)
    often = coded.join(F.broadcast(frequent), same)
    # The other rows leave before the shuffle.
    others = coded.join(F.broadcast(frequent.select("of")), same, "left_anti")
    rest = others.join(sums.filter(F.col("n") <= total // _FREQUENT), same)
    return often.unionByName(rest).drop("of", "n")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(id_column, code, error, label_error, codebooks_sha256)`` of every usable vector, with codebooks of its own table."""
    rows, length = integers(vectors, id_column, vector, label)
    books = fit(rows, length) if length else np.zeros((PARTS, 0, 1), np.int64)
    coded = materialize(encode(rows, books), "codes")
    found = with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books_sha256(books)))
    return found.select(F.col("id").alias(id_column), "code", "error", "label_error", "codebooks_sha256")
