"""Words of a corpus grouped with their spelling variants, one edit apart, by search schemes over bidirectional FM-indexes.

If two words differ by one inserted, deleted or replaced letter, the edit lies in the second half of the one, and its first
half begins the other, or it lies in the first half, and its second half ends the other. So a word is searched in two
ways: one half is matched exactly, outward from the middle to the delimiter, and then the search extends across
the other half, where one error is allowed at any place. The index is over the delimited vocabulary and over its
reverse; an interval of suffix ranks is kept for both, so a match can grow at either end.

The vocabulary is never in one place. A word is stored by its length and its first letters, and again by its length and
its last letters, as many as every search for it must match exactly. Those keys are hashed to buckets of about
``BUCKET`` words; the searches of a word go to the buckets of the keys it can have partners under. A task reads a bucket's words, builds
the index, and lets the searches stream by. A key with more words than a bucket is spread over several, to each of which its searches go;
so no key, however frequent, is in one task, and every pair is met exactly once for each half.

Defined results: null texts have no words; a null id counts as an empty one. Repeated documents count each. Words of any
length are searched. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescale.llm.text import gather, pieces
from tonescale.session import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
#: One run in so many loses a letter.
EVERY = 97
#: Words of an index.
BUCKET = 8192
#: Different words that a task counts before it passes the counts on.
_HELD = 200_000
#: Searches that run side by side in a task.
_SEARCHES = 4096

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_in(counts: Counter, doc_id: object, text: str) -> None:
    """Adds the words of a text to ``counts``; runs that are too short to be a word are left out."""
    low = text.encode().translate(_LOWER).decode()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(low)).items():
        if len(run) < MIN_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        counts[run] += n


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of all words with at least ``least`` occurrences, stored."""
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches, 1, 1 << 20):
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words_in(counts, i, value)
            if len(counts) >= _HELD:
                yield batch_of(counts)
                counts = Counter()
        yield batch_of(counts)

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.filter(F.col("n") >= least), "words")


class Index:
    """Bidirectional FM-index of a list of different words, each between two delimiters.

    A match is ``(low, reverse, size)``: the rank of its first suffix in the text and in the reversed text, and how many there are.
    """

    _BLOCK = 64

    def __init__(self, words: list[str]) -> None:
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("latin-1"), np.uint8)
        self.letters = np.unique(text)
        self.code = np.zeros(256, np.int64)
        self.code[self.letters] = np.arange(len(self.letters))
        self.known = np.zeros(256, bool)
        self.known[self.letters] = True
        coded = self.code[text]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(coded))])
        self.starts = np.flatnonzero(text[:-1] == 0) + 1
        self.places = self._suffixes(coded)
        self.tables = [self._ranks(coded, self.places), self._ranks(coded[::-1], self._suffixes(coded[::-1]))]
        self.size = len(coded)

    @staticmethod
    def _suffixes(coded: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling. The text is read as a ring, whose turns all differ, as its words do."""
        rank, step, n = coded.astype(np.int64), 1, len(coded)
        while True:
            key = rank * (n + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            changed = np.concatenate([[0], np.diff(key[order]) != 0])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(changed)
            step *= 2
            if rank[order[-1]] == n - 1 or step >= 2 * n:
                return order

    def _ranks(self, coded: np.ndarray, places: np.ndarray):
        """The letters before the suffixes, in blocks, and how many of each letter there are before each block."""
        before = coded[places - 1].astype(np.uint8)
        blocks = len(before) // self._BLOCK + 1
        padded = np.full(blocks * self._BLOCK, 255, np.uint8)
        padded[: len(before)] = before
        padded = padded.reshape(blocks, self._BLOCK)
        counts = np.zeros((blocks + 1, len(self.letters)), np.int32)
        np.add.at(counts, (np.arange(len(before)) // self._BLOCK + 1, before), 1)
        counts = np.cumsum(counts, axis=0, dtype=np.int32)
        below = np.concatenate([np.zeros((blocks + 1, 1), np.int32), np.cumsum(counts, axis=1, dtype=np.int32)], axis=1)
        return padded, counts, below

    def _count(self, table, at: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the letters before rank ``at`` are this one, and how many are smaller."""
        padded, counts, below = table
        block, inside = at // self._BLOCK, at % self._BLOCK
        seen = padded[block]
        early = np.arange(self._BLOCK, dtype=np.uint8) < inside.astype(np.uint8)[:, None]
        letter8 = letter.astype(np.uint8)[:, None]
        same = ((seen == letter8) & early).sum(axis=1, dtype=np.int64)
        less = ((seen < letter8) & early).sum(axis=1, dtype=np.int64)
        return counts[block, letter] + same, below[block, letter] + less

    def grow(self, match, letter: np.ndarray, left: bool):
        """The matches with one more letter at one end."""
        low, reverse, size = match
        near, far = (low, reverse) if left else (reverse, low)
        table = self.tables[0 if left else 1]
        same_a, less_a = self._count(table, near, letter)
        same_b, less_b = self._count(table, near + size, letter)
        near = self.first[letter] + same_a
        far = far + less_b - less_a
        return (near, far, same_b - same_a) if left else (far, near, same_b - same_a)

    def choices(self, match, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(number of the match, letter)`` for each letter that stands next to a match at one end, delimiters left out."""
        low, reverse, size = match
        near, padded = (low if left else reverse), self.tables[0 if left else 1][0]
        few = size <= len(self.letters)
        own = np.repeat(np.flatnonzero(few), size[few])
        pairs = np.unique(own << 8 | padded.ravel()[gather(near[few], size[few])].astype(np.int64))
        rest = np.flatnonzero(~few)
        every = np.repeat(rest, len(self.letters)) << 8 | np.tile(np.arange(len(self.letters)), len(rest))
        pairs = np.concatenate([pairs, every])
        pairs = pairs[(pairs & 255) > 0]
        return pairs >> 8, pairs & 255

    def words_of(self, low: np.ndarray, shift: int) -> np.ndarray:
        """The numbers of the words that matches, each of one suffix, lie in."""
        return np.searchsorted(self.starts, self.places[low] + shift, side="right") - 1


def search(index: Index, words: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the searched word, number of the word found)``, all that differ from it by one edit outside the half that is matched."""
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    known, data = index.known[data], index.code[data]
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size) - size
    half = size // 2
    # Outward: from the middle to the delimiter at the outer end. Then inward, across the other half.
    outward = first_half
    step = -1 if first_half else 1
    at = np.where(first_half, half - 1, half)
    n = len(words)
    match = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.size))
    who = np.arange(n)
    done: list[tuple] = []
    while len(who):
        over = (at[who] < 0) | (at[who] >= size[who])
        place = np.where(over, 0, begin[who] + at[who])
        letter = np.where(over, 0, data[place])
        grown = index.grow(match, letter, outward)
        live = (grown[2] > 0) & (over | known[place])
        ended = live & over
        if ended.any():
            done.append((who[ended], *(x[ended] for x in grown)))
        live &= ~over
        who, match = who[live], tuple(x[live] for x in grown)
        at[who] += step
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, *match = (np.concatenate(x) for x in zip(*done))
    inward, step = not outward, -step
    at = np.where(first_half, half, half - 1)[who]
    # Rows without an error so far, and rows with one; ``at`` is the next letter of the searched word.
    exact, wrong = (who, at, tuple(match)), (who[:0], at[:0], tuple(x[:0] for x in match))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(exact[0]) or len(wrong[0]):
        who, at, match = exact
        inside = (at >= 0) & (at < size[who])
        place = np.where(inside, begin[who] + at, 0)
        parent, letter = index.choices(match, inward)
        grown = index.grow(tuple(x[parent] for x in match), letter, inward)
        own = inside[parent] & known[place[parent]] & (letter == data[place[parent]])
        some = grown[2] > 0
        # Another letter in place of the next one; one more letter before it; the next one left out.
        swap = some & inside[parent] & ~own
        more = some
        left_out = inside & (size[who] > 1)
        added = [
            (who[parent][swap], at[parent][swap] + step, tuple(x[swap] for x in grown)),
            (who[parent][more], at[parent][more], tuple(x[more] for x in grown)),
            (who[left_out], at[left_out] + step, tuple(x[left_out] for x in match)),
        ]
        go = some & own
        exact = (who[parent][go], at[parent][go] + step, tuple(x[go] for x in grown))
        # Rows with an error match the rest exactly, up to the delimiter.
        who, at, match = (np.concatenate([wrong[0], *(a[0] for a in added)]), np.concatenate([wrong[1], *(a[1] for a in added)]),
                          tuple(np.concatenate([wrong[2][i], *(a[2][i] for a in added)]) for i in range(3)))
        over = (at < 0) | (at >= size[who])
        place = np.where(over, 0, begin[who] + at)
        grown = index.grow(match, np.where(over, 0, data[place]), inward)
        live = (grown[2] > 0) & (over | known[place])
        ended = live & over
        if ended.any():
            # The match begins at the delimiter before the word.
            found.append((who[ended], index.words_of(grown[0][ended], 1)))
        live &= ~over
        wrong = (who[live], at[live] + step, tuple(x[live] for x in grown))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, word = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(who * len(index.starts) + word)
    return pairs // len(index.starts), pairs % len(index.starts)


# Which halves of words meet: 0 for the first, 1 for the second.
_HALVES = (0, 1)


def _key(word: Column, length: Column, half: int) -> Column:
    """The key of words of a length: the letters that all searches for them match exactly at that end."""
    if half == 0:
        piece = F.substring(word, F.lit(1), F.floor((length - 1) / 2).cast("int"))
    else:
        piece = F.right(word, F.floor(length / 2).cast("int"))
    return F.xxhash64(F.lit(half), length, piece)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key", "share"), F.lit(buckets)) * 2 + F.col("half")


def _placed(words: DataFrame, size: int) -> DataFrame:
    """``(bucket, asks, word, n)``: the words of each bucket, and the searches that go there."""
    buckets = max(1, -(-words.count() // size))
    length = F.length("word")
    own = F.array(*[F.struct(F.lit(h).cast("long").alias("half"), _key(F.col("word"), length, h).alias("key")) for h in _HALVES])
    stored = words.select("word", "n", F.explode(own).alias("at")).select("word", "n", "at.half", "at.key")
    # At most one key for ``size`` of the stored words has more words than that.
    shares = stored.groupBy("key").agg(F.count("*").alias("words")).filter(F.col("words") > size)
    shares = materialize(shares.select("key", F.ceil(F.col("words") / size).cast("int").alias("shares")), "shares")
    asked = F.array(
        *[
            F.struct(F.lit(h).cast("long").alias("half"), _key(F.col("word"), length + d, h).alias("key"))
            for h in _HALVES
            for d in (-1, 0, 1)
        ]
    )
    searches = words.select("word", F.explode(asked).alias("at")).select("word", "at.half", "at.key")
    n_shares = F.coalesce("shares", F.lit(1))
    stored = stored.join(F.broadcast(shares), "key", "left").withColumn("share", F.pmod(F.xxhash64("word"), n_shares).cast("int"))
    searches = searches.join(F.broadcast(shares), "key", "left").withColumn("share", F.explode(F.sequence(F.lit(0), n_shares - 1)))
    return stored.select(_bucket(buckets).alias("bucket"), F.lit(False).alias("asks"), "word", "n").unionByName(
        searches.select(_bucket(buckets).alias("bucket"), F.lit(True).alias("asks"), "word", F.lit(0).cast("long").alias("n"))
    )


def _answered(index: Index, words: list[str], n: np.ndarray, asked: list[str], half: int) -> pa.RecordBatch:
    """For each search that finds something: how many words, and the most frequent of them."""
    who, found = search(index, asked, half == 0)
    if half == 1 and len(who):
        # What begins with the first half was met there.
        fresh = [not words[j].startswith(asked[i][: len(asked[i]) // 2]) for i, j in zip(who.tolist(), found.tolist())]
        who, found = who[fresh], found[fresh]
    # Words are in code-point order.
    order = np.lexsort((found, -n[found], who))
    who, found = who[order], found[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    best = found[first]
    columns = [
        pa.array([asked[i] for i in who[first].tolist()], pa.string()),
        pa.array(np.diff(np.append(first, len(who))), pa.int64()),
        pa.array(n[best], pa.int64()),
        pa.array([words[j] for j in best.tolist()], pa.string()),
    ]
    return pa.record_batch(columns, ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, size: int = BUCKET) -> DataFrame:
    """``(word, n_near, near_n, near)``: for a word and a bucket with words one edit away, how many and the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index = None, None
        own: list[str] = []
        counts: list[int] = []
        asked: list[str] = []
        last = None

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal index, asked
            if asked and own:
                index = index or Index(own)
                yield _answered(index, own, np.array(counts, np.int64), asked, bucket % 2)
            asked = []

        for batch in batches:
            for to, asks, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if to != bucket:
                    yield from answers()
                    bucket, index, own, counts, last = to, None, [], [], None
                if not asks:
                    own.append(word)
                    counts.append(n)
                elif word != last:  # two keys of a search may lead to one bucket
                    asked.append(word)
                    last = word
                    if len(asked) >= _SEARCHES:
                        yield from answers()
        yield from answers()

    dealt = _placed(words, size).repartition("bucket").sortWithinPartitions("bucket", "asks", "word")
    return dealt.mapInArrow(run, "word string, n_near long, near_n long, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the forms of words lead to in the end; each round doubles the steps that were followed."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        now = materialize(
            now.join(further, F.col("root") == F.col("via"), "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = BUCKET) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word.

    The form is the near word of the largest count, if that is at least twice the word's own; of equal counts the first word in code-point order.
    """
    words = vocabulary(docs, id_column, text)
    known = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,near:string>").alias("best"))
    met = near_words(words, size).select(
        "word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("near_n")).alias("less"), "near").alias("best")
    )
    grouped = known.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    chosen = -F.col("best.less") >= 2 * F.col("n")
    formed = materialize(
        grouped.select(
            "word", F.when(chosen, F.col("best.near")).alias("form"), "n", "n_near", F.when(chosen, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
