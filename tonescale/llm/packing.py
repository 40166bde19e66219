"""Packing documents into sequences: best fit, then a swap-based local search.

Texts become token ids once; longer documents are cut into pieces of the capacity, and only the
sizes of the pieces travel on. Pieces of full capacity are sequences of their own. The
others are dealt evenly into groups of bounded size, whatever their source; each group is packed by
best fit in decreasing order and improved: an underfull sequence, the emptiest first, gives pieces to, or exchanges one
for one, one for two or two for one with, those at least as full, whenever that raises the sum of squared fills,
until it is empty. The search of a group ends at the least number of sequences its sizes allow, or where no
underfull sequence has such an exchange left. The emptiest sequence of every group is opened again and packed with
those of the other groups, until one group is left, so each group costs no sequence of its own.

Defined results: a null or empty text is its end id alone. Repeated rows, and rows with a null id, are
documents of their own. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.llm.bpe import encode_with_end
from tonescale.llm.text import pieces, texts_of
from tonescale.session import materialize

CAPACITY = 2048
#: Pieces that are packed together, about.
GROUP = 30_000
#: Bytes of text whose ids a task holds at once: with what is made on the way, some twenty times as much memory.
RUN_BYTES = 2 << 20


def token_pieces(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; only documents longer than the capacity are cut."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in pieces(batches, 1, RUN_BYTES):
            ids, counts = encode_with_end(texts_of(batch.column(1)), path, end_id)
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, np.array(crc, np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], ["id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return found.withColumnRenamed("id", id_column)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the fullest bin it fits into."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


class _Bins:
    """The items of each bin, their sizes, and the sums of two items of one bin, as arrays that follow the exchanges."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.items, self.capacity = [list(b) for b in bins], capacity
        self.sizes = np.array(sizes, np.int64)
        self.bin_of = np.empty(len(sizes), np.int64)
        for b, items in enumerate(bins):
            self.bin_of[items] = b
        self.fill = np.array([self.sizes[items].sum() for items in bins], np.int64)
        self._list_pairs()

    def _pairs_of(self, b: int) -> np.ndarray:
        """Rows ``(bin, item, item)``."""
        items = np.array(self.items[b], np.int64)
        i, j = np.triu_indices(len(items), 1)
        return np.stack([np.full(len(i), b), items[i], items[j]], 1)

    def _list_pairs(self) -> None:
        rows = [self._pairs_of(b) for b in range(len(self.items)) if self.fill[b] < self.capacity]
        self.pairs = np.concatenate([np.empty((0, 3), np.int64), *rows])
        self.pair_sizes = self.sizes[self.pairs[:, 1]] + self.sizes[self.pairs[:, 2]]

    def exchange(self, giver: int, takers: np.ndarray) -> int | None:
        """The exchange with one of the bins marked in ``takers`` that raises the sum of squared fills most; the other bin, or None."""
        room = np.where(takers, self.capacity - self.fill, 0)
        room[giver] = 0
        if not room.any():
            return None
        own = self.items[giver]
        alone = {int(self.sizes[i]): (i,) for i in own}
        both = {int(self.sizes[i] + self.sizes[j]): (i, j) for k, i in enumerate(own) for j in own[k + 1 :]}
        gap = self.fill - self.fill[giver]
        best, found = 0, None

        def seek(given: dict[int, tuple], bins: np.ndarray, taken: np.ndarray, back) -> None:
            nonlocal best, found
            left, above = room[bins], gap[bins]
            for size, items in given.items():
                more = size - taken
                gain = np.where((more > 0) & (more <= left), more * (above + more), 0)
                if len(gain) and gain[at := int(gain.argmax())] > best:
                    best, found = int(gain[at]), (int(bins[at]), items, back(at))

        open_bins = np.flatnonzero(room)
        seek(alone | both, open_bins, np.zeros(len(open_bins), np.int64), lambda at: ())
        one = np.flatnonzero(room[self.bin_of])
        seek(alone | both, self.bin_of[one], self.sizes[one], lambda at: (int(one[at]),))
        two = np.flatnonzero(room[self.pairs[:, 0]])
        seek(alone, self.pairs[two, 0], self.pair_sizes[two], lambda at: tuple(self.pairs[two[at], 1:].tolist()))
        if not found:
            return None
        taker, give, take = found
        for b, out, come in ((giver, give, take), (taker, take, give)):
            self.items[b] = [i for i in self.items[b] if i not in out] + list(come)
            self.bin_of[list(come)] = b
            self.fill[b] = self.sizes[self.items[b]].sum()
        # Full bins take part no more, so only what is left of the two is listed again.
        keep = (self.pairs[:, 0] != giver) & (self.pairs[:, 0] != taker)
        new = [self._pairs_of(b) for b in (giver, taker) if 0 < self.fill[b] < self.capacity]
        self.pairs = np.concatenate([self.pairs[keep], *new])
        added = sum(map(len, new))
        fresh = self.pairs[len(self.pairs) - added :]
        self.pair_sizes = np.concatenate([self.pair_sizes[keep], self.sizes[fresh[:, 1]] + self.sizes[fresh[:, 2]]])
        return taker


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by exchanges that raise the sum of squared fills; ends at the least number of bins or where none is left.

    A giver is never fuller than the taker, so every exchange raises the sum, which is bounded. All underfull bins are tried
    in turn, the emptiest first, again and again; one that found none only with those that have changed since.
    """
    least = -(-sum(sizes) // capacity)
    if sum(map(bool, bins)) <= least:
        return [b for b in bins if b]
    state = _Bins(bins, sizes, capacity)
    fill, step = state.fill, 0
    changed, tried = np.zeros(len(bins), np.int64), np.full(len(bins), -1)
    alive = int((fill > 0).sum())
    while alive > least:
        under = np.flatnonzero((fill > 0) & (fill < capacity) & (tried < step))
        if not len(under):
            break
        for giver in under[np.argsort(fill[under], kind="stable")].tolist():
            while 0 < fill[giver] < capacity and alive > least:
                since = -1 if changed[giver] > tried[giver] else tried[giver]
                taker = state.exchange(giver, (fill >= fill[giver]) & (changed > since))
                if taker is None:
                    tried[giver] = step
                    break
                step += 1
                changed[[giver, taker]] = step
                alive -= not fill[giver]
    return [b for b in state.items if b]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _packer(capacity: int, turn: int, last: bool):
    """Packs one group. Unless it is the last of all, its emptiest sequence is marked as open."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_slot", ignore_index=True)
        sizes = rows["length"].tolist()
        bins = pack_sizes(sizes, capacity)
        fills = [sum(sizes[i] for i in b) for b in bins]
        opened = None if last else min(range(len(bins)), key=fills.__getitem__)
        sequence, offset, is_open = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i], is_open[i] = turn << 56 | int(key[0]) << 24 | b, at, b == opened
                at += sizes[i]
        return rows.drop(columns="_group").assign(sequence_id=sequence, offset=offset, _open=is_open)

    return run


def pack(sized: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of ``sized`` (column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    stored = materialize(sized.withColumn("_slot", F.monotonically_increasing_id()), "pieces")
    full = stored.filter(F.col("length") >= capacity)
    done = [full.withColumns({"sequence_id": F.col("_slot").bitwiseOR(F.lit(1 << 62)), "offset": F.lit(0).cast("long")})]
    left, turn = stored.filter(F.col("length") < capacity), 0
    out = left.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "_open": F.lit(True)})
    schema = out.schema
    while True:
        groups = max(1, -(-left.count() // group))
        keyed = left.withColumn("_group", F.pmod(F.xxhash64("_slot"), F.lit(groups)))
        packed = materialize(keyed.groupBy("_group").applyInPandas(_packer(capacity, turn, groups == 1), schema), "packed")
        done.append(packed.filter(~F.col("_open")).drop("_open"))
        if groups == 1:
            break
        left, turn = packed.filter("_open").drop("sequence_id", "offset", "_open"), turn + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("_slot")


def pack_documents(
    docs: DataFrame, path: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: where it was cut, and its sequence and place there."""
    return pack(token_pieces(docs, path, end_id, capacity, id_column, text), capacity)
