"""A word language model with Katz backoff.

Counts are discounted by Good-Turing: a count r of at most ``CUT`` becomes d_r r with Katz's d_r, and larger
ones give up a small fixed part, so every history leaves some mass. The mass that a history leaves is
given to the words not seen after it, in proportion to their lower-order probability; the backoff weight normalises that exactly.

Words and the end of a text are tokens; the end is also what precedes a first word. Every token is a history and a word of its own,
however rare; one unknown type has the mass that unigram discounts leave. So probabilities add up to 1 over all known words and the unknown
one, after each history. Only on request (``vocabulary``) tokens beyond the most frequent ones are merged: they are one class, predicted as the
class, then as themselves by their share of its unigram mass.

With u(w) = log P(w) and b(h) the logarithm of the backoff weight, a pair adds b(h) + u(w), and d(h, w) besides if it was seen. In a text the
histories are its tokens again, so a score is the sum of b + u over tokens and of d over pairs: each is one look-up.

Tokens have numbers by frequency: the ``LOCAL`` most frequent ones are known where the text is, all others go by a 62-bit hash. Pairs are counted,
stored and asked for in buckets, whose number grows with the tokens: a pair of two frequent tokens lies in the bucket of its own hash, a pair with a
rare word in that of the word, any other with a rare history in that of the history. So the bucket of a rare word has its count and probability, and only what
histories keep is summed across buckets. Each run of text sends one packed row (sorted keys as differences, by byte planes) to a
bucket, not a row for each pair, and a bucket is read as a stream behind its table. What it answers for a run of text is one packed row too, with a sum for
each text; the sums of a run meet in one small group, so there are never more of them than pairs asked for. Runs and their rows are numbered in the pass that
sends them, so no second reading of the input has to agree with it. Tables are partitioned by order. What the driver
or every task holds is bounded: ``LOCAL`` tokens and the ``FREQUENT`` bigrams, which are not asked for, so none of the others is hot.

Defined results: a null or empty text is its end alone. Repeated rows, and rows with a null id, are texts of their own; a null id counts as an
empty one when it decides whether a text is held out. Other columns of the input are ignored. An empty table gives no rows; with no
training text all tokens are unknown and have probability 1.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tonescale.llm.text import SPACE_CUT_LOWER, cut_words, pieces, texts_of
from tonescale.session import scratch, scratch_path

CUT = 5
#: Part of a count above ``CUT`` that is given up.
REST = 0.01
LOCAL = 1 << 18
FREQUENT = 1 << 18
#: Bytes of text in a run: some twenty arrays of its tokens are held at once.
RUN_BYTES = 4 << 20
#: Training tokens for each bucket of pairs.
PER_BUCKET = 1 << 21
#: Files of a scratch table for each core, at most.
FILES = 2
_WORD, _END = 1 << 62, 1 << 61
# What a row holds: pairs of frequent tokens, with a rare word, with a rare history; rare tokens; rare histories of rare words; a text's own sums.
# From ``_ASKED`` on: what is asked about pairs of the first three kinds.
_BOTH, _BY_WORD, _BY_HISTORY, _TOKENS, _LINKS, _OWN, _ASKED = range(7)
_ROW = "bucket int, kind int, a binary, o binary, n binary, x binary"
#: Fixed values of the base score: what is added to each count.
ADDED = 0.1


def _held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids.to_pylist()], bool)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(values, codes, ends)``: 62-bit word hashes and last the end token, which of them each token is, and where texts end."""
    words, ends = cut_words(texts, SPACE_CUT_LOWER)
    coded, digest = words.dictionary_encode(), xxhash.xxh64_intdigest
    hashes = [digest(w) & (_WORD - 1) | _WORD for w in coded.dictionary.to_pylist()]
    codes = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(hashes))
    return np.array([*hashes, _END], np.int64), codes, ends + np.arange(1, len(ends) + 1)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(tokens, ends)``, with the end token after each text."""
    values, codes, ends = _coded(texts)
    return values[codes], ends


def _pairs(codes: np.ndarray, size: int) -> np.ndarray:
    """Code of the token before, times ``size``, plus the code: texts end with the end token, so it also precedes every first word."""
    return np.concatenate([[size - 1], codes[:-1]]) * size + codes if len(codes) else codes


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """64-bit numbers by byte planes, as differences if they rise."""
    x = np.ascontiguousarray(x).view(np.int64)
    planes = np.ascontiguousarray((np.diff(x, prepend=0) if rising else x).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, rising: bool = False, kind: type = np.int64) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], 8 * size, "zstd"), np.uint8).reshape(8, size)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(x) if rising else x


def _mixed(x: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of these keys."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _summed(a: np.ndarray, o: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(a, o)`` in order, with the sums of ``n``."""
    order = np.lexsort((o, a))
    a, o, n = a[order], o[order], n[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (o[1:] != o[:-1]))[: len(a)])
    return a[new], o[new], np.add.reduceat(n, new) if len(new) else n


class _Pairs:
    """Counts of sorted ``(a, o)``, to be looked up."""

    def __init__(self, a: np.ndarray, o: np.ndarray, c: np.ndarray) -> None:
        first = np.append(True, a[1:] != a[:-1])[: len(a)]
        self.a, at = a[first], np.cumsum(first) - 1
        self.o, of = np.unique(o, return_inverse=True)
        self.key, self.c = at * max(len(self.o), 1) + of, np.append(c, 0)

    def count(self, a: np.ndarray, o: np.ndarray) -> np.ndarray:
        """0 for pairs that are not there."""
        at, of = _find(self.a, a), _find(self.o, o)
        there = (at < len(self.a)) & (of < len(self.o))
        return self.c[np.where(there, _find(self.key, at * max(len(self.o), 1) + of), len(self.key))]


def _find(table: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in a sorted table; its length for what is not there."""
    if not len(table):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return np.where(table[at] == asked, at, len(table))


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))


class _Ids:
    """Numbers of the vocabulary's tokens; all others share the last one."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.order = np.argsort(tokens)
        self.sorted, self.size = tokens[self.order], len(tokens)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, tokens), self.size - 1)
        return np.where(self.sorted[at] == tokens, self.order[at], self.size)


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """d_0 (unused), d_1 .. d_CUT by Good-Turing. Where the counts do not give values between 0 and 1, half a count is given up."""
    n = [0.0] + [float(counts_of_counts.get(r, 0)) for r in range(1, CUT + 2)]
    found = [1.0]
    cut = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        found.append(d if 0 < d < 1 else (r - 0.5) / r)
    return found


def discounted(d: list[float], c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, np.float64)
    small = np.array(d)[np.minimum(c, CUT).astype(np.int64)]
    return np.where(c <= CUT, small * c, c - REST)


def _discounted_sql(d: list[float]):
    out = F.col("c") - F.lit(REST)
    for r in range(1, CUT + 1):
        out = F.when(F.col("c") == r, F.lit(d[r] * r)).otherwise(out)
    return out


@dataclass
class _Layout:
    """Which tokens have numbers, and in which bucket a pair lies."""

    top: np.ndarray
    merged: bool
    buckets: int

    def placed(self, h: np.ndarray, w: np.ndarray, hn: np.ndarray, wn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(kind, bucket, a, o)`` of pairs of tokens with these numbers: the key's first part and its second, 0 for two frequent tokens."""
        size = len(self.top)
        if self.merged:
            kind = np.full(len(h), _BOTH)
        else:
            kind = np.where(wn == size, _BY_WORD, np.where(hn == size, _BY_HISTORY, _BOTH))
        a = np.where(kind == _BOTH, hn * (size + 1) + wn, np.where(kind == _BY_WORD, w, h))
        o = np.where(kind == _BOTH, 0, np.where(kind == _BY_WORD, np.where(hn < size, hn, h), wn))
        return kind, _mixed(a, self.buckets), a, o


@dataclass
class Katz:
    """A fitted model. The tables are in ``folder``; the arrays hold the most frequent tokens and bigrams."""

    folder: str
    n: int
    types: int
    layout: _Layout
    d1: list[float]
    d2: list[float]
    counts: np.ndarray
    #: Of the frequent tokens, and of all others if they are merged: log P as a word, backoff weight, and that with the logarithm of the count.
    u: np.ndarray
    b: np.ndarray
    x: np.ndarray
    unknown: float
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def base_log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c, np.float64) + ADDED) / (self.n + ADDED * (self.types + 1)))

    def word(self, c: np.ndarray) -> np.ndarray:
        """log P of words of these counts, all known."""
        return np.log10(discounted(self.d1, c) / max(self.n, 1))

    def kept(self, c: np.ndarray) -> np.ndarray:
        """What a pair keeps, as a logarithm; 0 for pairs that are not known."""
        return np.log10(np.where(c > 0, discounted(self.d2, np.maximum(c, 1)), 1.0))

    def both(self, key: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What pairs of frequent tokens with these counts add."""
        side = len(self.layout.top) + 1
        return np.where(c > 0, self.kept(c) - self.x[key // side] - self.u[key % side], 0.0)


def _count_words(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in pieces(batches, 1, RUN_BYTES):
            values, codes, ends = _coded(texts_of(batch.column(1)))
            train = np.repeat(~_held_out(batch.column(0)), np.diff(ends, prepend=0))
            n = np.bincount(codes[train], minlength=len(values))
            yield pa.record_batch([pa.array(values[n > 0]), pa.array(n[n > 0])], ["key", "n"])

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


def _cut_buckets(kind: np.ndarray, bucket: np.ndarray, a: np.ndarray, o: np.ndarray, more: list[np.ndarray]):
    """``(kind, bucket, a, o, more)`` of each bucket and kind that has entries, in the order of ``a`` and ``o``."""
    place = bucket * 3 + kind
    order = np.lexsort((o, a, place))
    place, a, o, more = place[order], a[order], o[order], [x[order] for x in more]
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)]).tolist()
    for i, j in zip(cuts, cuts[1:] + [len(place)]):
        yield int(place[i]) % 3, int(place[i]) // 3, a[i:j], o[i:j], [x[i:j] for x in more]


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * (len(names) - 2)
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


_NAMES = ["bucket", "kind", "a", "o", "n", "x"]


def _count_pairs(rows: DataFrame, layout: _Layout) -> DataFrame:
    def counted(ids: _Ids, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        values, codes, ends = _coded(texts_of(batch.column(1)))
        train = np.repeat(~_held_out(batch.column(0)), np.diff(ends, prepend=0))
        keys, n = np.unique(_pairs(codes, len(values))[train], return_counts=True)
        h, w, numbers = keys // len(values), keys % len(values), ids.of(values)
        return *layout.placed(values[h], values[w], numbers[h], numbers[w]), [n]

    def run(batches):
        ids = _Ids(layout.top)
        for batch in pieces(batches, 1, RUN_BYTES):
            parts = ((k, at, *_summed(a, o, n)) for k, at, a, o, (n,) in _cut_buckets(*counted(ids, batch)))
            yield _packed([(at, k, pack(a, True), pack(o), pack(n), None) for k, at, a, o, n in parts], _NAMES)

    def merge(key, table):
        a, o, n = _summed(*(np.concatenate([unpack(x, c == "a") for x in table.column(c).to_pylist()]) for c in "aon"))
        return pa.Table.from_batches([_packed([(key[0].as_py(), key[1].as_py(), pack(a, True), pack(o), pack(n), None)], _NAMES)])

    return rows.mapInArrow(run, _ROW).groupBy("bucket", "kind").applyInArrow(merge, _ROW)


def _each(batches):
    """``(bucket, kind, a, o, n, x)`` of the rows of a table, one at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            bucket, kind, a, o, n, x = (batch.column(i)[r].as_py() for i in range(6))
            yield bucket, kind, unpack(a, True), unpack(o), unpack(n), x


def _few_files(rows: DataFrame) -> DataFrame:
    """In at most ``FILES`` parts for each core: a file costs the executor a few processes, however little is in it."""
    return rows.coalesce(FILES * rows.sparkSession.sparkContext.defaultParallelism)


def _count_of_counts(table: DataFrame) -> dict[int, int]:
    rows = table.filter(F.col("c") <= CUT + 1).groupBy("c").count().collect()
    return {r["c"]: r["count"] for r in rows}


def _pair_counts(table: DataFrame) -> DataFrame:
    """``(frequent, c, n)``: how many pairs, of frequent tokens or not, occur so often."""

    def run(batches):
        for _, kind, _, _, n, _ in _each(batches):
            c, k = np.unique(n, return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(c), kind == _BOTH)), pa.array(c), pa.array(k)], ["frequent", "c", "n"])

    return table.mapInArrow(run, "frequent boolean, c long, n long").groupBy("frequent", "c").agg(F.sum("n").alias("n"))


def _pairs_from(table: DataFrame, least: int) -> DataFrame:
    """Pairs of frequent tokens that occur so often."""

    def run(batches):
        for _, _, a, _, n, _ in _each(batches):
            yield pa.record_batch([pa.array(a[n >= least]), pa.array(n[n >= least])], ["key", "c"])

    return table.filter(F.col("kind") == _BOTH).mapInArrow(run, "key long, c long")


def _histories(table: DataFrame, layout: _Layout, p: np.ndarray, n: int, d1: list[float], d2: list[float], everything: int) -> DataFrame:
    """``(h, c, b, whole)``: how often a history occurs, its backoff weight and what its pairs are divided by, as logarithms."""

    def run(batches):
        side = len(layout.top) + 1
        for _, kind, a, o, c, _ in _each(batches):
            if kind == _BOTH:
                h, lower = a // side, p[a % side]
            elif kind == _BY_WORD:
                _, at = np.unique(a, return_inverse=True)
                h, lower = o, (discounted(d1, np.bincount(at, c)) / n)[at]
            else:
                h, lower = a, p[o]
            h, at = np.unique(h, return_inverse=True)
            sums = [np.bincount(at, x, len(h)) for x in (c, discounted(d2, c), lower)]
            yield pa.record_batch([pa.array(x) for x in (h, sums[0].astype(np.int64), sums[1], sums[2], np.bincount(at, minlength=len(h)))], ["h", "c", "k", "p", "seen"])

    sums = table.mapInArrow(run, "h long, c long, k double, p double, seen long").groupBy("h").agg(*[F.sum(x).alias(x) for x in ("c", "k", "p", "seen")])
    # After a history that was followed by everything there is nothing to back off to: what it keeps is all.
    all_of_them = F.col("seen") == everything
    backoff = F.when(all_of_them, F.lit(0.0)).otherwise(F.log10((1 - F.col("k") / F.col("c")) / F.greatest(1 - F.col("p"), F.lit(1e-12))))
    whole = F.log10(F.when(all_of_them, F.col("k")).otherwise(F.col("c").cast("double")))
    return sums.select("h", "c", backoff.alias("b"), whole.alias("whole"))


def _in_buckets(rows: DataFrame, kind: int) -> DataFrame:
    """One packed row for the ``(bucket, a, c, b, whole)`` of a bucket."""

    def run(key, table):
        table = table.sort_by("a")
        a, c, b, whole = (table.column(x).to_numpy() for x in ("a", "c", "b", "whole"))
        return pa.Table.from_batches([_packed([(key[0].as_py(), kind, pack(a, True), pack(c), pack(b), pack(b + whole))], _NAMES)])

    return rows.groupBy("bucket").applyInArrow(run, _ROW)


def _rare_tokens(known: DataFrame, layout: _Layout) -> DataFrame:
    """``(bucket, a, c, b, whole)`` of the ``(a, c, b, whole)`` of tokens without a number."""

    def run(batches):
        ids = _Ids(layout.top)
        for batch in batches:
            a = batch.column(0).to_numpy()
            rare = (a >= _END) & (ids.of(a) == len(layout.top))
            yield pa.record_batch([pa.array(_mixed(a, layout.buckets)), *batch.columns], ["bucket", "a", "c", "b", "whole"]).filter(pa.array(rare))

    return known.mapInArrow(run, "bucket long, a long, c long, b double, whole double").withColumn("bucket", F.col("bucket").cast("int"))


def _rare_links(table: DataFrame) -> DataFrame:
    """``(bucket, h)``: rare histories of the rare words of a bucket."""

    def run(batches):
        for bucket, _, _, o, _, _ in _each(batches):
            h = np.unique(o[o >= _END])
            yield pa.record_batch([pa.array(np.full(len(h), bucket, np.int32)), pa.array(h)], ["bucket", "h"])

    return table.filter(F.col("kind") == _BY_WORD).mapInArrow(run, "bucket int, h long")


def _arrays(table: DataFrame) -> list[np.ndarray]:
    """The columns of a small table."""
    found = table.toArrow()
    return [found.column(i).to_numpy() for i in range(found.num_columns)]


def _pair_steps(counts: DataFrame) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """How many pairs occur so often, up to ``CUT + 1``; and of those of frequent tokens ``(least count, how many)``, from the most
    frequent ones on, by a scale of eight steps for each doubling: a few hundred numbers."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8)
    low = F.when(F.col("c") <= CUT + 1, F.col("c"))
    found = counts.groupBy("frequent", step.alias("step"), low.alias("c")).agg(F.sum("n").alias("n"), F.min("c").alias("low")).collect()
    small = {c: sum(r["n"] for r in found if r["c"] == c) for c in range(1, CUT + 2)}
    steps: dict[int, tuple[int, int]] = {}
    for r in found:
        if r["frequent"]:
            least, n = steps.get(r["step"], (r["low"], 0))
            steps[r["step"]] = min(least, r["low"]), n + r["n"]
    return small, [steps[k] for k in sorted(steps, reverse=True)]


def _threshold(steps: list[tuple[int, int]], most: int) -> int:
    """The least count that at most ``most`` pairs of frequent tokens reach."""
    total, low = 0, 1 << 62
    for least, n in steps:
        total += n
        if total > most:
            break
        low = least
    return low


def fit(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: int | None = None, frequent: int = FREQUENT, local: int = LOCAL
) -> Katz:
    """Learns from the texts that are not held out. With ``vocabulary``, all tokens but so many are one class in bigrams."""
    spark, folder, rows = docs.sparkSession, scratch_path(docs.sparkSession, "katz"), _texts(docs, id_column, text)
    merged = vocabulary is not None
    with scratch(spark):
        raw = scratch_path(spark, "katz-counts")
        _few_files(_count_words(rows)).write.parquet(f"{raw}/words")
        words = spark.read.schema("key long, c long").parquet(f"{raw}/words")
        n, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        d1 = discounts(_count_of_counts(words))
        top, counts = _arrays(words.orderBy(F.desc("c"), "key").limit(vocabulary if merged else local).select("key", "c"))
        known = words.agg(F.coalesce(F.sum(_discounted_sql(d1)), F.lit(0.0))).first()[0]
        unknown = 1 - known / n if n else 1.0
        p = discounted(d1, counts) / max(n, 1)
        # That of all other words where they are one class; else it is not asked for.
        p = np.append(p, max(1 - p.sum(), unknown) if merged else 1.0)
        layout = _Layout(top, merged, max(1, -(-n // PER_BUCKET)))

        _count_pairs(rows, layout).write.parquet(f"{folder}/order=2")
        pairs = spark.read.schema(_ROW).parquet(f"{folder}/order=2")
        low_counts, steps = _pair_steps(_pair_counts(pairs))
        d2 = discounts(low_counts)
        everything = (len(top) + 1 if merged else types + 1)
        _few_files(_histories(pairs, layout, p, n, d1, d2, everything)).write.parquet(f"{raw}/histories")
        histories = spark.read.schema("h long, c long, b double, whole double").parquet(f"{raw}/histories")
        at, found_b, found_whole = _arrays(histories.filter(F.col("h") <= len(top)).select("h", "b", "whole"))
        b, x = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
        b[at], x[at] = found_b, found_b + found_whole

        if merged:
            known_tokens = words.select(F.col("key").alias("a"), "c", F.lit(float(b[-1])).alias("b"), F.lit(0.0).alias("whole"))
        else:
            known_tokens = histories.select(F.col("h").alias("a"), "c", "b", "whole")
        links = _rare_links(pairs).join(histories, "h").select("bucket", F.col("h").alias("a"), "c", "b", "whole")
        tokens = _in_buckets(_rare_tokens(known_tokens, layout), _TOKENS).unionByName(_in_buckets(links, _LINKS))
        tokens.write.parquet(f"{folder}/order=1")
        often, often_counts = _arrays(_pairs_from(pairs, _threshold(steps, frequent)))

    by_key = np.argsort(often)
    return Katz(folder, n, types, layout, d1, d2, counts, np.log10(p), b, x, unknown, often[by_key], often_counts[by_key])


class _Bucket:
    """The tables of one bucket, and what they add to texts."""

    def __init__(self, model: Katz) -> None:
        none = np.zeros(0, np.int64)
        self.m, self.pairs = model, [_Pairs(none, none, none) for _ in range(3)]
        self.tokens = self.links = (none, none, np.zeros(0), np.zeros(0))

    def learn(self, kind: int, a: bytes, o: bytes, n: bytes, x: bytes | None) -> None:
        if kind < _TOKENS:
            self.pairs[kind] = _Pairs(unpack(a, True), unpack(o), unpack(n))
            return
        found = unpack(a, True), unpack(o), unpack(n, kind=np.float64), unpack(x, kind=np.float64)
        if kind == _TOKENS:
            self.tokens = found
        else:
            self.links = found

    def _histories(self, table: tuple, h: np.ndarray) -> np.ndarray:
        """Weight and count of histories, frequent or in the table; 0 for one that is not known, as none of its pairs is."""
        size, at = len(self.m.layout.top), _find(table[0], h)
        return np.where(h < size, self.m.x[np.clip(h, 0, size)], np.append(table[3], 0.0)[at])

    def added(self, kind: int, a: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(known, base, total)`` of what is asked for."""
        m, c, zero = self.m, self.pairs[kind].count(a, o), np.zeros(len(a))
        if kind == _BOTH:
            return zero, zero, m.both(a, c)
        if kind == _BY_HISTORY:
            return zero, zero, np.where(c > 0, m.kept(c) - self._histories(self.tokens, a) - m.u[o], 0.0)
        at = _find(self.tokens[0], a)
        count, known = np.append(self.tokens[1], 0)[at], at < len(self.tokens[0])
        u = m.word(np.maximum(count, 1))
        own = np.where(known, np.append(self.tokens[2], 0.0)[at] + u, math.log10(m.unknown) + (m.b[-1] if m.layout.merged else 0.0))
        return known.astype(float), m.base_log10(count), own + np.where(c > 0, m.kept(c) - self._histories(self.links, o) - u, 0.0)


def score(docs: DataFrame, model: Katz, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_column, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every text."""
    spark, rows = docs.sparkSession, _texts(docs, id_column, text)
    kind_of_id = rows.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["id"].dataType)
    shared = spark.sparkContext.broadcast(model)
    own_types = [pa.int64(), pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    own_names = ["run", "row", "id", "held_out", "n_tokens", "n_known", "base", "total"]
    found_schema = f"id {kind_of_id}, held_out boolean, n_tokens long, n_known long, base double, total double"
    own_schema = f"run long, row long, {found_schema}"
    sum_names = ["rows", "knowns", "bases", "totals"]

    def asked_of(m: Katz, ids: _Ids, frequent: _Ids, batch: pa.RecordBatch) -> tuple[list[pa.Array], tuple]:
        """What is known at the texts of a run, as columns; and ``(kind, bucket, a, o, [times, row])`` of what others are asked."""
        layout, size, n_rows = m.layout, len(m.layout.top), batch.num_rows
        values, codes, ends = _coded(texts_of(batch.column(1)))
        row, numbers = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), ids.of(values)
        here = numbers < size
        base, total = np.zeros(len(values)), np.zeros(len(values))
        base[here], total[here] = m.base_log10(m.counts[numbers[here]]), (m.u + m.b)[numbers[here]]
        distinct, pair = np.unique(_pairs(codes, len(values)), return_inverse=True)
        h, w = distinct // len(values), distinct % len(values)
        kind, bucket, a, o = layout.placed(values[h], values[w], numbers[h], numbers[w])
        del distinct, h, w
        at = np.where(kind == _BOTH, frequent.of(a), len(m.frequent))
        often = np.zeros(len(at))
        is_often = at < len(m.frequent)
        often[is_often] = m.both(a[is_often], m.frequent_counts[at[is_often]])
        own = [
            pa.array(np.arange(n_rows)), batch.column(0), pa.array(_held_out(batch.column(0))),
            pa.array(np.bincount(row, minlength=n_rows)), pa.array(np.bincount(row, here[codes], n_rows).astype(np.int64)),
            pa.array(np.bincount(row, base[codes], n_rows).astype(float)), pa.array(np.bincount(row, total[codes] + often[pair], n_rows).astype(float)),
        ]
        del at, often
        others = np.flatnonzero(~is_often[pair])
        asked, times = np.unique(pair[others] * n_rows + row[others], return_counts=True)
        del others, pair
        which, where = asked // n_rows, asked % n_rows
        kind, bucket, a, o = kind[which], bucket[which], a[which], o[which]
        if layout.merged:
            # The words themselves, beside the pairs of their class.
            rare = np.flatnonzero(~here[codes])
            asked, more = np.unique(codes[rare] * n_rows + row[rare], return_counts=True)
            word = values[asked // n_rows]
            kind, bucket = np.append(kind, np.full(len(word), _BY_WORD)), np.append(bucket, _mixed(word, layout.buckets))
            a, o = np.append(a, word), np.append(o, np.full(len(word), -1))
            where, times = np.append(where, asked % n_rows), np.append(times, more)
        return own, (kind, bucket, a, o, [times, where])

    def ask(batches):
        """What is known at the text, as a row of each text; and what others are asked, as a row for each bucket and run of texts."""
        m, first = shared.value, TaskContext.get().partitionId() << 36
        ids, frequent = _Ids(m.layout.top), _Ids(m.frequent)
        for batch in pieces(batches, 1, RUN_BYTES):
            n_rows = batch.num_rows
            own, others = asked_of(m, ids, frequent, batch)
            places = pa.array(((first + np.arange(n_rows)) % m.layout.buckets).astype(np.int32))
            own = [pa.array(np.full(n_rows, first)), *own]
            yield pa.record_batch([places, pa.array(np.full(n_rows, _OWN, np.int32)), *[pa.nulls(n_rows, pa.binary())] * 4, *own], [*_NAMES, *own_names])

            parts = [(b, _ASKED + k, pack(a, True), pack(o), pack(n), pack(r)) for k, b, a, o, (n, r) in _cut_buckets(*others)]
            del others
            if parts:
                nulls = [pa.array([first] * len(parts), pa.int64()), *[pa.nulls(len(parts), t) for t in own_types[1:]]]
                yield pa.record_batch([*_packed(parts, _NAMES).columns, *nulls], [*_NAMES, *own_names])
            first += n_rows

    def answer(batches):
        """The rows of the texts, and for each run of texts what a bucket adds, packed. A bucket's tables come before what it is asked."""
        m, tables, current = shared.value, None, None
        for batch in batches:
            own = batch.filter(pc.equal(batch.column(1), _OWN)).select(own_names)
            yield pa.record_batch([*own.columns, *[pa.nulls(own.num_rows, pa.binary())] * 4], [*own_names, *sum_names])
            for i in np.flatnonzero(batch.column(1).to_numpy() != _OWN):
                bucket, kind, a, o, n, x = (batch.column(j)[i].as_py() for j in range(6))
                if bucket != current:
                    tables, current = _Bucket(m), bucket
                if kind < _ASKED:
                    tables.learn(kind, a, o, n, x)
                    continue
                times, rows_at = unpack(n), unpack(x)
                added = tables.added(kind - _ASKED, unpack(a, True), unpack(o))
                found, at = np.unique(rows_at, return_inverse=True)
                sums = [pack(found, True), *[pack(np.bincount(at, times * y, len(found)).astype(float)) for y in added]]
                nulls = [pa.nulls(1, t) for t in own_types[1:]]
                yield pa.record_batch([batch.column(6).slice(i, 1), *nulls, *[pa.array([y], pa.binary()) for y in sums]], [*own_names, *sum_names])

    def finish(table):
        """The texts of one run with all that buckets add to them."""
        own = table.filter(pc.is_null(table.column("rows"))).sort_by("row")
        sums = [own.column(c).to_numpy().astype(float) for c in ("n_known", "base", "total")]
        for answers in table.filter(pc.is_valid(table.column("rows"))).select(sum_names).to_batches(max_chunksize=64):
            for at, *added in zip(*(answers.column(i).to_pylist() for i in range(4))):
                for total, blob in zip(sums, added):
                    total[unpack(at, True)] += unpack(blob, kind=np.float64)
        columns = [*(own.column(c) for c in ("id", "held_out", "n_tokens")), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.table(columns, names=["id", *own_names[3:]])

    table = spark.read.schema(_ROW).parquet(f"{model.folder}/order=1", f"{model.folder}/order=2")
    asked = rows.mapInArrow(ask, f"{_ROW}, {own_schema}")
    in_order = asked.unionByName(table, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "kind")
    answered = in_order.mapInArrow(answer, f"{own_schema}, {', '.join(f'{c} binary' for c in sum_names)}")
    found = answered.groupBy("run").applyInArrow(finish, found_schema)
    return found.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("total").alias("score"),
    )
