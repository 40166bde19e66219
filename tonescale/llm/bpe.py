"""Token ids by a public tokenizer, each distinct word encoded once.

The tokenizer cuts a text at white space and between letters, digits and punctuation before it
merges anything, so what stands between such cuts has the same ids wherever it stands. A batch of texts
is cut at those that are safe whatever stands around them: white space, and the change between
an ASCII letter or digit and ASCII punctuation other than an apostrophe, which begins contractions. The
ids of the texts are gathered from those of the distinct words. Frequent words stay encoded per worker.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

from tonescale.llm.text import SPACE_CUT, SPACE_CUT_LOWER, gather, strings, text_bytes

#: Encoded words a worker keeps before those not seen since are let go; it has twice as many at most.
KEPT_WORDS = 300_000

_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def cut_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``(pieces, ends)``: lower-cased pieces whose ids do not depend on each other, and how many end with each text."""
    raw, offsets = text_bytes(texts)
    # A marker such as <|endoftext|> is one token, in this case only: texts with one are cut at white space.
    marked = bool((raw[:-1][raw[1:] == 124] == 60).any()) if len(raw) else False
    data = (SPACE_CUT if marked else SPACE_CUT_LOWER)[raw]
    word = data != 32
    cut = np.ones(len(data) + 1, bool)  # between the byte before and this one
    if len(data):
        cut[1:-1] = word[:-1] != word[1:]
        if not marked:
            alnum, marks = _ALNUM[data], _MARKS[data]
            cut[1:-1] |= (alnum[:-1] & marks[1:]) | (marks[:-1] & alnum[1:])
    cut[offsets] = True
    starts, stops = np.flatnonzero(word & cut[:-1]), np.flatnonzero(word & cut[1:]) + 1
    return strings(data[word], stops - starts), np.searchsorted(starts, offsets[1:], side="left")


class WordEncoder:
    def __init__(self, path: str) -> None:
        # One task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        kept, older = self._kept, self._older
        found = [kept.get(w) or older.get(w) for w in words]
        new = [w for w, ids in zip(words, found) if ids is None]
        encode = getattr(self._tokenizer, "encode_batch_fast", self._tokenizer.encode_batch)
        made = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = [x.ids for x in encode(part, add_special_tokens=False)]
            flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes()
            stops = (np.cumsum([len(x) for x in ids]) * 4).tolist()
            made.update((w, flat[a:b]) for w, a, b in zip(part, [0, *stops], stops))
        found = [made[w] if ids is None else ids for w, ids in zip(words, found)]
        if len(kept) + len(words) > KEPT_WORDS:
            self._older, self._kept = kept, dict(itertools.islice(zip(words, found), KEPT_WORDS))
        else:
            kept.update(zip(words, found))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the ids of all texts, and how many each text has."""
        words, ends = cut_pieces(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids = self._ids(distinct)
        lengths = np.array([len(x) for x in ids], np.int64) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(lengths) - lengths
        per_word = lengths[codes]
        totals = np.concatenate([[0], np.cumsum(per_word)])
        return flat[gather(starts[codes], per_word)], np.diff(totals[ends], prepend=0)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_with_end(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``WordEncoder.encode``, with ``end_id`` after every text."""
    ids, counts = encoder(path).encode(texts)
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id).astype("<u4", copy=False), counts + 1
