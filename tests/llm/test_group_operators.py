"""Near-duplicates, phrases, packing, token codes: results over many rows."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonescale.llm import bpe, dac, packing, phrases, simhash
from tonescale.llm.links import components
from tonescale.session import materialize

SCHEMA = "doc_id long, text string, id string, component_id string, length string"


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def roots_of(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()}
    want = roots_of(260, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("distance, crowd", [(4, 64), (4, 3), (2, 64)])
def test_simhash_against_all_pairs(spark, distance, crowd, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (distance, crowd))
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É", "Straße"]
    texts = [None, "", " \n", "Á", "a b c", "A B c"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120, 700]))]
        for _ in range(rng.randint(1, 9)):
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(" ".join(changed))
    docs = table(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 7")).unionByName(spark.createDataFrame([(None, texts[8], "", "", "")], SCHEMA))
    got = simhash.near_duplicates(docs, distance=distance).collect()
    assert len(got) == len(texts) + 2
    prints = [plain_fingerprint(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    want = roots_of(len(texts), edges)
    for r in got:
        i = 8 if r["doc_id"] is None else r["doc_id"]
        assert r["fp"] & (1 << 64) - 1 == prints[i] and r["component_id"] == want[i]


def test_links_hold_across_crowded_groups(spark):
    """Dense balls of fingerprints around two centres that are themselves within reach of each other's edge."""
    rng = random.Random(4)
    centres = [rng.getrandbits(64)]
    centres.append(centres[0] ^ 0b11111 << 20)
    values = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 4]
    want = roots_of(len(values), edges)
    for crowd in (5, 1000):
        found = [(values.index(r["a"]), values.index(r["b"])) for r in simhash.links(nodes, 4, crowd).collect()]
        assert all(((values[a] ^ values[b]) & (1 << 64) - 1).bit_count() <= 4 for a, b in found)
        assert roots_of(len(values), found) == want


def test_no_exploded_keys_go_through_the_driver(spark, monkeypatch):
    """However small the table of fingerprints: its keys are some sixty times as many rows as Spark expects."""
    plans = {}

    def stored(df, label):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(simhash, "materialize", stored)
    nodes = spark.createDataFrame([(v << 40 | 1 << v % 9,) for v in range(20)], "fp long")
    found = simhash.links(nodes, 4, 3)
    plans["links"] = found._jdf.queryExecution().sparkPlan().toString()
    assert [plans[x].count("SortMergeJoin") for x in ("stars", "links")] == [1, 6]
    assert not any("BroadcastHashJoin" in plans[x] for x in ("stars", "links"))


def test_no_fingerprints_of_documents_go_through_the_driver(spark):
    """Their files are small where many are equal, and their keys are structs."""
    docs = table(spark, ["a b c", "a b c", "d e f"])
    found = simhash.near_duplicates(docs.select(F.struct("doc_id", "id").alias("key"), "text"), "key")
    joins = re.findall(r"\w+Join\w* \[\w+", found._jdf.queryExecution().sparkPlan().toString())
    assert [x.split("#")[0] for x in joins if x.endswith("[fp")] == ["SortMergeJoin [fp"] * 3


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = table(spark, [text, text + " ", "other words here entirely", None])
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == [0, 2, 3]
    assert simhash.deduplicated(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, value in items:
        w = plain_words(value)
        for i in range(max(1, len(w) - 12) if w else 0):
            win = w[i : i + 13]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found.add(item or "")
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block, at_once", [(20_000, 1 << 21), (3, 1 << 21), (20_000, 1), (20_000, 2), (20_000, 3), (3, 6)])
def test_contamination_against_scanning(spark, block, at_once, monkeypatch):
    monkeypatch.setattr(phrases, "ITEM_BLOCK", block)
    monkeypatch.setattr(phrases, "_AT_ONCE", at_once)
    rng = random.Random(6)
    vocabulary = ["the", "of", "Én", "x1"] + [f"v{i}" for i in range(6)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 20])))) for i in range(8)]
    items += [("8", None), ("9", "..."), (None, "rare phrase"), ("0", items[0][1]), ("0", "second text")]
    texts = [None, "", "!", "the", "a RARE, phrase!", "rare", "phrase second"]
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            words[rng.randint(0, len(words)) : 0] = (rng.choice(items)[1] or "").split()
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, doc_id int")
    got = {r["doc_id"]: r for r in phrases.contamination(table(spark, texts), bench).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == plain_contamination(text, items), text
    digest = phrases.contamination_digest(table(spark, texts), bench).filter("doc_id = 4").first()
    assert digest["items_sha256"] == hashlib.sha256(b"").hexdigest() and digest["contaminated"] and digest["n_items"] == 1
    none = phrases.contamination(table(spark, texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["n_hit"] for r in none)
    assert phrases.contamination(table(spark, texts).limit(0), bench).count() == 0


def test_the_index_is_made_stored_and_searched_in_bounded_rows(spark):
    rng = random.Random(5)
    vocabulary, item = [f"w{i}" for i in range(5_000)], " ".join(f"bench{i}" for i in range(15))
    texts = [" ".join(rng.choices(vocabulary, k=3_000)) for _ in range(500)]
    planted = set(range(0, 500, 7))
    texts = [f"{item} {t} {item}" if i in planted else t for i, t in enumerate(texts)]
    docs = table(spark, texts).coalesce(1)
    index = phrases.build_index(docs)
    runs = [r["ids"] for r in index.orderBy("run").collect()]
    assert [i for ids in runs for i in ids] == list(range(500))
    assert max(sum(len(texts[i]) for i in ids) for ids in runs) <= 2 << 20
    files = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in index.inputFiles()]
    assert max(f.row_group(g).total_byte_size for f in files for g in range(f.num_row_groups)) < 8 << 20
    bench = spark.createDataFrame([("i1", item)], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in phrases.contamination(docs, bench).collect()}
    assert got == {i: (3_030, 30, ["i1"]) if i in planted else (3_000, 0, []) for i in range(500)}


def test_proximity_against_scanning(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    queries = {"q1": "a b", "q2": "c d e", "q3": "h", "none": "zz a"}
    index = phrases.build_index(table(spark, texts))
    for width in (1, 3, 7):
        got = {(r["query"], r["doc_id"], r["place"]) for r in phrases.near_terms(index, queries, width).collect()}
        want = set()
        for q, text in queries.items():
            terms = set(text.split())
            for d, t in enumerate(texts):
                words = t.split()
                want |= {(q, d, i) for i in range(len(words)) if words[i] in terms and terms <= set(words[i : i + width])}
        assert got == want


@pytest.mark.parametrize("at_once", [1, 2, 3, 4, 6, 7])
def test_no_window_is_lost_where_candidates_fill_whole_runs(at_once, monkeypatch):
    monkeypatch.setattr(phrases, "_AT_ONCE", at_once)
    row = phrases.index_rows(0, pa.array([1]), pa.array(["a b a b a b c d c d c d"]))
    terms = pa.array(["a", "b", "c", "d"])
    opened = phrases._Run(*(row.column(i)[0].as_py() for i in (3, 4, 5, 2)), terms)
    windows = np.array([[0, 1], [2, 3]])
    found = [(int(w), int(s)) for ws, ss in opened.phrases(windows, np.array([[0, 1], [0, 1]])) for w, s in zip(ws, ss)]
    assert sorted(found) == [(0, 0), (0, 2), (0, 4), (1, 6), (1, 8), (1, 10)]


TOKENIZER = "word_bpe_49k.json"
ODD = [None, "", " \n ", "a<|endoftext|>b <|startoftext|>", "it's don't  x\x1cy", "ÀÉ ǅ ΑΣ İ ﬁ", "Hello, World... 3.14 ''s 'Sam"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(bpe.vocabulary_path(TOKENIZER))


def test_word_encoding_equals_the_tokenizer(plain):
    rng = random.Random(9)
    letters = "aB3éß'.,-!<|> \n\x1cst'ldÉ中١_ ﬁ"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for batch in (texts, [t for t in texts if "<|" not in t]):
        ids, counts = bpe.encoder(TOKENIZER).encode(pa.array(batch))
        at = 0
        for text, n in zip(batch, counts):
            assert plain.encode(text, add_special_tokens=False).ids == ids[at : at + n].tolist(), text
            at += n
        assert at == len(ids)


@pytest.mark.parametrize("group, slack", [(25, 5), (packing.GROUP, 2)])
def test_packing_round_trip(spark, plain, group, slack):
    rng = random.Random(10)
    texts = [*ODD, "x y " * 2048, "z " * 4095] + [" ".join(rng.choice(["ab", "tree", "Ünder"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = packing.pack(packing.token_pieces(table(spark, texts), TOKENIZER), group=group).collect()
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048)) and sum(r["length"] for r in own) == len(ids)
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 2048) + slack
    assert packing.pack_documents(table(spark, texts).limit(0)).count() == 0


def test_packing_holds_the_ids_of_few_texts_at_once(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(2000)) for _ in range(800)]
    docs, tasks = table(spark, [""]), []
    made = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: tasks.append(f) or made(self, f, schema))
    packing.token_pieces(docs, TOKENIZER)
    bpe.encoder(TOKENIZER)._ids([f"w{i}" for i in range(2000)])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in tasks[0](iter([pa.record_batch([pa.array(range(800)), pa.array(texts)], ["id", "text"])])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 800 and sum(map(len, texts)) > 8 << 20 and peak < 80 << 20


def test_local_search_empties_bins():
    # Best fit leaves three bins; an exchange of two for one leaves two.
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]
    bins = packing.local_search([[0, 6], [1, 4], [2, 5], [3, 7]], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(8)) and all(sum(sizes[i] for i in b) <= 10 for b in bins)
    assert len(bins) == 3
    assert packing.pack_sizes([], 10) == [] and packing.pack_sizes([10, 10], 10) == [[0], [1]]
    rng = random.Random(11)
    for _ in range(20):
        sizes = [rng.randint(1, 50) for _ in range(200)]
        first = packing.best_fit(sizes, 100)
        last = packing.local_search(first, sizes, 100)
        assert len(last) <= len(first) and sorted(i for b in last for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= 100 for b in last)


def helps(giver, taker, sizes, capacity):
    """Whether any exchange of these two bins raises the sum of squared fills, by trying all."""
    room = capacity - sum(sizes[i] for i in taker)
    for give, take in ((1, 0), (2, 0), (1, 1), (2, 1), (1, 2)):
        for out in itertools.combinations(giver, give):
            for back in itertools.combinations(taker, take):
                if 0 < sum(sizes[i] for i in out) - sum(sizes[i] for i in back) <= room:
                    return True
    return False


@pytest.mark.parametrize("low, high, capacity", [(15, 55, 100), (20, 45, 100), (25, 50, 101), (1, 70, 100), (300, 1100, 2048)])
def test_local_search_ends_where_no_exchange_is_left(low, high, capacity):
    rng, emptied = random.Random(low), 0
    for _ in range(8):
        sizes = [rng.randint(low, high) for _ in range(rng.choice([7, 80, 240]))]
        first = packing.best_fit(sizes, capacity)
        last = packing.local_search(first, sizes, capacity)
        fill = [sum(sizes[i] for i in b) for b in last]
        assert sorted(i for b in last for i in b) == list(range(len(sizes))) and max(fill) <= capacity
        emptied += len(first) - len(last)
        if len(last) > -(-sum(sizes) // capacity):
            for giver, taker in itertools.permutations(range(len(last)), 2):
                assert fill[giver] > fill[taker] or fill[giver] == capacity or not helps(last[giver], last[taker], sizes, capacity)
    assert emptied or low == 1


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_codes_give_every_id(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**32, n, dtype=np.uint32) >> rng.integers(0, 32, n, dtype=np.uint32)
    code = dac.Code(dac.encode(ids))
    assert len(code) == n and (code.all() == ids).all() and all(code[i] == ids[i] for i in range(n))


def test_code_files_round_trip(spark, plain, tmp_path):
    texts = [*ODD, "some words of a text " * 50, "tie", "tie"]
    docs = table(spark, texts, first=5).unionByName(spark.createDataFrame([(None, "first", "", "", "")], SCHEMA)).repartition(4)
    folder = str(tmp_path / "codes")
    dac.write(docs, folder)
    got = sorted(dac.read(spark, folder).collect(), key=lambda r: r["start"])
    at, whole = 0, []
    for r, text in zip(got, ["first", *texts], strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        whole += ids.tolist()
    assert [r["doc_id"] for r in got] == [None, *range(5, 5 + len(texts))]
    places = spark.createDataFrame([(i,) for i in range(0, at, 7)], "place long")
    assert {r["place"]: r["token_id"] for r in dac.tokens_at(spark, folder, places).collect()} == {i: whole[i] for i in range(0, at, 7)}
    dac.write(docs.limit(0), folder)
    assert dac.read(spark, folder).count() == 0
