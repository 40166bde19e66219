"""Phrases and terms of test items in training texts, by a distributed positional inverted index.

The index is split by documents: each row of the stored table covers a run of documents and holds,
for each term in them, the ascending list of its places. Building it moves no text between tasks, and a
search sends the test phrases, in blocks of bounded size, to the rows. A phrase is looked up
from its rarest term on, by the counts of the whole index: the term's places, less its offset in the phrase,
are the candidate starts, and the list of each next rarer term, adjusted by its own offset, is intersected with what is left.

Defined results: null and empty texts have no words and no hits. Repeated documents, and those with a null id, each get their
own row; repeated items, and items that share an id, count once in ``n_items``, and a null item id counts as an
empty one. Items without words are ignored. Other columns are ignored. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescale.llm.text import ALNUM_CUT_LOWER, cut_words, gather, pieces, texts_of
from tonescale.session import materialize

WINDOW = 13
#: Test items that are sent to the tasks at once, and the bytes of their texts.
ITEM_BLOCK = 20_000
ITEM_BYTES = 2 << 20
#: Candidate places that are held at once.
_AT_ONCE = 1 << 21
#: Text of one row of the index: what a task holds at once, and more on the way, when it makes or searches it.
_TEXT = 2 << 20
#: Such rows are written and read a few at a time, each column of one in a page of its own: else the JVM holds those of a whole file.
_FILES = {
    "parquet.block.size": 4 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
    "parquet.enable.dictionary": False,
}


def words_of(text: str | None) -> list[str]:
    return cut_words(texts_of(pa.array([text], pa.string())), ALNUM_CUT_LOWER)[0].to_pylist()


def index_rows(run: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row of the index, for a run of documents.

    ``terms`` are the distinct words, separated by line breaks; ``ends[i]`` is where the list of term i ends
    in ``places``. Places count the words of the run, document after document; ``doc_ends`` says where those end.
    Numbers are little-endian uint32.
    """
    words, ends = cut_words(texts, ALNUM_CUT_LOWER)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy() if len(words) else np.zeros(0, np.int32)
    places = np.argsort(codes, kind="stable").astype("<u4")
    counts = np.bincount(codes, minlength=len(coded.dictionary)) if len(words) else np.zeros(0, np.int64)
    columns = [
        pa.array([run]),
        pa.array([ids.to_pylist()], pa.list_(ids.type)),
        pa.array([ends.astype("<u4").tobytes()], pa.binary()),
        pa.array(["\n".join(coded.dictionary.to_pylist())], pa.string()),
        pa.array([np.cumsum(counts).astype("<u4").tobytes()], pa.binary()),
        pa.array([places.tobytes()], pa.binary()),
    ]
    return pa.record_batch(columns, ["run", "ids", "doc_ends", "terms", "ends", "places"])


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all words of all texts."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(pieces(batches, 1, _TEXT)):
            yield index_rows(first + i, batch.column(0), texts_of(batch.column(1)))

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"run long, ids array<{kind}>, doc_ends binary, terms string, `ends` binary, places binary"
    return materialize(rows.mapInArrow(run, schema), "index", options=_FILES)


class _Run:
    """An opened row of the index, with the lists of some terms only."""

    def __init__(self, terms: str, ends: bytes, places: bytes, doc_ends: bytes, asked: pa.Array) -> None:
        own = pa.array(terms.split("\n") if terms else [], pa.string())
        at = pc.index_in(asked, value_set=own)
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.frombuffer(ends, "<u4").astype(np.int64)
        here = at >= 0
        self.counts, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[here] = np.where(at[here] > 0, stops[at[here] - 1], 0)
        self.counts[here] = stops[at[here]] - starts[here]
        self.doc_ends = np.frombuffer(doc_ends, "<u4").astype(np.int64)
        if places is not None:
            # One ascending list: the term in the upper half, its places in the lower.
            lists = np.frombuffer(places, "<u4")[gather(starts, self.counts)].astype(np.int64)
            self.lists = np.repeat(np.arange(len(at)) << 32, self.counts) | lists
            self.first = np.cumsum(self.counts) - self.counts

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term << 32 | place
        at = np.searchsorted(self.lists, key)
        found = np.zeros(len(key), bool)
        inside = at < len(self.lists)
        found[inside] = self.lists[at[inside]] == key[inside]
        return found & (place >= 0)

    def phrases(self, windows: np.ndarray, order: np.ndarray):
        """Yields ``(window numbers, first places)``; rows of ``windows`` are term numbers, -1 beyond the end.

        ``order`` has, for each window, its offsets from the rarest term to the most frequent.
        """
        size = (windows >= 0).sum(1)
        present = ((windows < 0) | (self.counts[windows] > 0)).all(1)
        live = np.flatnonzero(present)
        rarest = order[live, 0]
        seed = windows[live, rarest]
        n = self.counts[seed]
        upto = np.cumsum(n)
        cuts = np.searchsorted(upto, np.arange(_AT_ONCE, n.sum(), _AT_ONCE))
        bounds = np.unique(np.concatenate([[0], cuts, [len(live)]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = slice(a, b)
            window = np.repeat(live[part], n[part])
            start = (self.lists[gather(self.first[seed[part]], n[part])] & 0xFFFFFFFF) - np.repeat(rarest[part], n[part])
            for k in range(1, windows.shape[1]):
                at = order[window, k]
                term = windows[window, at]
                keep = (term < 0) | self.has(np.maximum(term, 0), start + at)
                window, start = window[keep], start[keep]
            ok = start >= 0
            window, start = window[ok], start[ok]
            doc = np.searchsorted(self.doc_ends, start, side="right")
            one = start + size[window] <= self.doc_ends[np.minimum(doc, len(self.doc_ends) - 1)]
            yield window[one], start[one]


def _counted(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """How often each term occurs in the whole index: sums of one number per row and term that has it."""

    def run(batches):
        for batch in batches:
            total = np.zeros(len(terms), np.int64)
            for row in range(batch.num_rows):
                own, ends = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                total += _Run(own, ends, None, b"", terms).counts
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], ["term", "n"])

    found = index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    counts = np.zeros(len(terms), np.int64)
    for term, n in found:
        counts[term] = n
    return counts


def _item_blocks(items: DataFrame, id_column: str, text: str):
    """The test items in blocks of bounded number and size; a stated query set, never the training texts."""
    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.col(text).cast("string")).distinct()
    block, size = [], 0
    for item, value in rows.toLocalIterator():
        block.append((item, value))
        size += len(value or "")
        if len(block) >= ITEM_BLOCK or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _windows(block, width: int):
    """Distinct windows as term numbers, the terms, and the items of each window."""
    terms: dict[str, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, value in block:
        words = [terms.setdefault(w, len(terms)) for w in words_of(value)]
        for i in range(max(1, len(words) - width + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + width]), set()).add(item)
    table = np.full((len(owners), width), -1, np.int64)
    for row, window in enumerate(owners):
        table[row, : len(window)] = window
    return table, pa.array(list(terms), pa.string()), [sorted(x) for x in owners.values()]


_HITS = "n_words long, runs array<struct<first:long,stop:long>>, items array<string>"


def _hits(index: DataFrame, block, width: int) -> DataFrame:
    """One row per document: its words, the runs of words that are covered, and the items that cover them."""
    windows, terms, owners = _windows(block, width)
    counts = _counted(index, terms)
    rank = np.where(windows < 0, np.iinfo(np.int64).max, counts[np.maximum(windows, 0)])
    order = np.argsort(rank, axis=1, kind="stable")
    kind = index.schema["ids"].dataType.elementType.simpleString()
    run_type = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        size = (windows >= 0).sum(1)
        for batch in batches:
            for row in range(batch.num_rows):
                number, ids, doc_ends, own, ends, places = (batch.column(i)[row] for i in range(6))
                opened = _Run(own.as_py(), ends.as_py(), places.as_py(), doc_ends.as_py(), terms)
                n = int(opened.doc_ends[-1]) if len(opened.doc_ends) else 0
                edges, pairs = np.zeros(n + 1, np.int64), [np.zeros((0, 2), np.int64)]
                for window, start in opened.phrases(windows, order):
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + size[window], -1)
                    doc = np.searchsorted(opened.doc_ends, start, side="right")
                    pairs.append(np.unique(np.stack([doc, window], 1), axis=0))
                first = np.concatenate([[0], opened.doc_ends[:-1]])
                covered = np.concatenate([[0], (np.cumsum(edges[:n]) > 0).astype(np.int8)])
                covered = np.append(covered, 0)
                # Runs end with their document: words of the next one are covered by windows of its own.
                turns = np.diff(covered)
                begins = np.union1d(np.flatnonzero(turns > 0), first[(first < n) & (covered[np.minimum(first + 1, n)] > 0)])
                stops = np.union1d(np.flatnonzero(turns < 0), opened.doc_ends[(opened.doc_ends > 0) & (covered[opened.doc_ends] > 0)])
                of = np.searchsorted(opened.doc_ends, begins, side="right")
                runs: list[list[dict]] = [[] for _ in first]
                for d, a, b in zip(of.tolist(), (begins - first[of]).tolist(), (stops - first[of]).tolist()):
                    runs[d].append({"first": a, "stop": b})
                items: list[set[str]] = [set() for _ in first]
                for doc, window in np.concatenate(pairs).tolist():
                    items[doc].update(owners[window])
                columns = [
                    pa.array(np.full(len(first), number.as_py())), pa.array(np.arange(len(first))), ids.values, pa.array(opened.doc_ends - first),
                    pa.array(runs, run_type), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ]
                yield pa.record_batch(columns, ["run", "nth", "id", "n_words", "runs", "items"])

    rows = index.select("run", "ids", "doc_ends", "terms", "ends", "places")
    return rows.mapInArrow(run, f"run long, nth long, id {kind}, {_HITS}")


def _covered(runs: Column) -> Column:
    """How many words lie in runs that may overlap."""
    step = F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), r["stop"] - F.greatest(a["end"], r["first"]))).alias("n"),
            F.greatest(a["end"], r["stop"]).alias("end"),
        ),
    )
    return step["n"]


def contamination(
    docs: DataFrame, items: DataFrame, width: int = WINDOW, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text"
) -> DataFrame:
    """``(id_column, n_words, n_hit, items)``: words inside an occurrence of a test window, and the ids of those items.

    A window is ``width`` consecutive words of an item, or all words of a shorter one.
    """
    index = build_index(docs, id_column, text)
    parts = []
    for block in _item_blocks(items, item_column, text):
        if parts:
            # The windows of one block at a time are on the driver and in the tasks.
            parts[-1] = materialize(parts[-1], "hits")
        parts.append(_hits(index, block, width))
    if len(parts) > 1:
        parts[-1] = materialize(parts[-1], "hits")
    found = parts[0] if parts else _hits(index, [], width)
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        found = found.groupBy("run", "nth").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return found.select(F.col("id").alias(id_column), "n_words", _covered(F.col("runs")).alias("n_hit"), F.array_sort("items").alias("items"))


def is_contaminated() -> Column:
    """The rule: some word is hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def near_terms(index: DataFrame, queries: dict[str, str], width: int, id_column: str = "doc_id") -> DataFrame:
    """``(query, id_column, place)``: proximity matches, where all terms of a query lie within ``width`` consecutive words.

    ``place`` is the first word of the leftmost such stretch that begins with a term of the query and holds all of
    them; one row for each such beginning. The stretches are grown from the places of the query's rarest term.
    """
    names = list(queries)
    asked = [sorted(set(words_of(queries[q]))) for q in names]
    terms = pa.array(sorted({w for words in asked for w in words}), pa.string())
    number = {w: i for i, w in enumerate(terms.to_pylist())}
    counts = _counted(index, terms)
    plans = [sorted((number[w] for w in words), key=lambda i: counts[i]) for words in asked]
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, doc_ends, own, ends, places = (batch.column(i)[row] for i in range(5))
                opened = _Run(own.as_py(), ends.as_py(), places.as_py(), doc_ends.as_py(), terms)
                lists = [opened.lists[f : f + n] & 0xFFFFFFFF for f, n in zip(opened.first, opened.counts)]
                for name, plan in zip(names, plans):
                    if not plan or not all(opened.counts[i] for i in plan):
                        continue
                    # Beginnings near the rarest term; then every other term has to come soon enough.
                    begin = np.unique(np.concatenate([lists[i] for i in plan]))
                    for i in plan:
                        nxt = np.searchsorted(lists[i], begin)
                        ok = nxt < len(lists[i])
                        begin, nxt = begin[ok], nxt[ok]
                        doc = np.searchsorted(opened.doc_ends, begin, side="right")
                        begin = begin[lists[i][nxt] < np.minimum(begin + width, opened.doc_ends[doc])]
                    doc = np.searchsorted(opened.doc_ends, begin, side="right")
                    first = np.concatenate([[0], opened.doc_ends[:-1]])
                    yield pa.record_batch(
                        [pa.array([name] * len(begin), pa.string()), ids.values.take(pa.array(doc)), pa.array(begin - first[doc])],
                        ["query", "id", "place"],
                    )

    rows = index.select("ids", "doc_ends", "terms", "ends", "places")
    return rows.mapInArrow(run, f"query string, id {kind}, place long").withColumnRenamed("id", id_column)
