"""Arrow batches of texts cut into words, for the operators that work in Python tasks.

A text column arrives as one buffer of UTF-8 bytes. Every separator used here is an
ASCII byte, so words are found with a table of 256 bytes and a few passes over the
buffer, and stay one Arrow array: no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = {32, *range(9, 14)}

#: Byte tables: what a byte becomes; 32 separates words.
SPACE_CUT = np.frombuffer(bytes(32 if b in _SPACES else b for b in range(256)), np.uint8)
SPACE_CUT_LOWER = np.frombuffer(bytes(32 if b in _SPACES else _LOWER[b] for b in range(256)), np.uint8)
ALNUM_CUT_LOWER = np.frombuffer(
    bytes(_LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)),
    np.uint8,
)

#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE_BYTES = 8 << 20


def texts_of(column: pa.Array) -> pa.Array:
    """The column as plain strings, nulls as empty texts."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)``; text i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow array of the strings of these lengths that follow each other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def cut_words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``(words, ends)``: the words of all texts, and after how many words each text ends."""
    data, offsets = text_bytes(texts)
    data = table[data]
    word = data != 32
    before, after = np.empty_like(word), np.empty_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False  # the texts follow each other without a separator
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return strings(data[word], stops - starts), np.searchsorted(starts, offsets[1:], side="left")


def pieces(batches: Iterator[pa.RecordBatch], text: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows of about ``size`` bytes of the column at ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(texts_of(batch.column(text)))[1][1:]
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def arrow_rows(make: Callable[[pa.RecordBatch], pa.RecordBatch], text: int = 1):
    """A function for ``mapInArrow``: ``make`` is applied to runs of rows of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield make(batch)

    return run
