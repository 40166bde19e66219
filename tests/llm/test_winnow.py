"""Winnowing against looking at every window."""

import hashlib
import random

import pytest

from tonescale.llm import winnow

SCHEMA = "doc_id long, text string, id string, stretch string, ahead string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "id", "stretch", "ahead") for i, t in rows], SCHEMA)


def gram_hash(gram):
    h = sum((ord(c) + 1) * pow(winnow._BASE, -j, 1 << 64) for j, c in enumerate(gram)) % (1 << 64)
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    h = (h ^ h >> 27) * 0x94D049BB133111EB % (1 << 64)
    return h >> 32


def plain(text):
    grams = [gram_hash(text[i : i + winnow.GRAM]) for i in range(max(1, len(text) - winnow.GRAM + 1))] if text else []
    kept = set()
    for at in range(max(1, len(grams) - winnow.WINDOW + 1) if grams else 0):
        window = grams[at : at + winnow.WINDOW]
        kept.add(max(at + i for i, h in enumerate(window) if h == min(window)))
    return sorted((i, grams[i]) for i in kept)


def plain_print(text):
    found, last = "", 0
    for i, h in plain(text):
        found += f"{i - last:02x}{h:08x}"
        last = i
    return found


def likeness(a, b):
    a, b = {h for _, h in plain(a)}, {h for _, h in plain(b)}
    return len(a & b) / len(a | b) if a | b else 1.0


def random_texts(rng, n):
    letters = "ab cdé中😀 "
    return [None, "", "a", "ab" * 9 + "c", "é" * 200, "ab" * 100] + ["".join(rng.choice(letters) for _ in range(rng.choice([5, 19, 20, 21, 66, 67, 68, 150, 400]))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1 << 20, 50, 130])
def test_fingerprints_against_every_window(spark, chunk, monkeypatch):
    monkeypatch.setattr(winnow, "CHUNK", chunk)
    texts = random_texts(random.Random(1), 40)
    own = [t or "" for t in texts]
    of, places, hashes = winnow.winnowed(own)
    got = [[] for _ in own]
    for i, p, h in zip(of.tolist(), places.tolist(), hashes.tolist()):
        got[i].append((p, h))
    assert [sorted(x) for x in got] == [plain(t) for t in own]
    rows = winnow.fingerprints(table(spark, enumerate(texts))).collect()
    assert {r["doc_id"]: (r["n_chars"], r["fingerprint"]) for r in rows} == {i: (len(t), plain_print(t)) for i, t in enumerate(own)}


@pytest.mark.parametrize("chunk, partitions", [(1 << 20, 8), (60, 1), (300, 40)])
def test_edited_texts_against_brute_force(spark, chunk, partitions, monkeypatch):
    monkeypatch.setattr(winnow, "CHUNK", chunk)
    rng = random.Random(2)
    texts = random_texts(rng, 150)
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: r for r in winnow.compare_edited(table(spark, rows).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        want = (i, n, hashlib.sha256(edited.encode()).hexdigest(), plain_print(text), plain_print(edited), likeness(text, edited), likeness(text, following))
        assert tuple(got[i]) == pytest.approx(want) if chunk != 60 else tuple(got[i])[:5] == want[:5]


def test_null_and_repeated_ids_single_and_no_documents(spark):
    alone = winnow.compare_edited(table(spark, [(1, "abcdef")])).collect()
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in alone] == [(1, 6, hashlib.sha256(b"abcabc").hexdigest())]
    assert winnow.compare_edited(table(spark, [])).count() == 0
    rows = [(7, "same text " * 10)] * 50 + [(None, f"text {i} " * 20) for i in range(50)] + [(None, None), (9, "first " * 30), (2, "x" * 90)]
    got = winnow.compare_edited(table(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r for r in got if r["doc_id"] in (2, 9)}
    # The first is followed by a repeated one, the smallest id by one without.
    assert of[9]["edited_sha256"] == hashlib.sha256(("first " * 30)[:90].encode() + ("same text " * 10)[:90].encode()).hexdigest()
    assert of[2]["edited_sha256"] in {hashlib.sha256(("x" * 45 + t[:45]).encode()).hexdigest() for i, t in rows if i is None and t} | {hashlib.sha256(b"x" * 45).hexdigest()}
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 7) == 49


def test_every_long_common_passage_is_found(spark):
    rng = random.Random(3)
    letters = "abcdefgh "
    for _ in range(60):
        passage = "".join(rng.choice(letters) for _ in range(winnow.GUARANTEE))
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(2))
        first, second = a + passage + b, b + passage + a
        found = winnow.shared(plain_print(first), plain_print(second))
        assert any(x - y == len(a) - len(b) and len(a) <= x <= len(a) + winnow.WINDOW - 1 for x, y in found)


def test_a_very_long_text(spark):
    text = "".join(random.Random(4).choice("abcdefghij ") for _ in range(3_000_000))
    of, places, _ = winnow.winnowed([text, text[:1000]])
    gaps = places[of == 0][1:] - places[of == 0][:-1]
    assert gaps.max() <= winnow.WINDOW and places[of == 0][0] < winnow.WINDOW
    assert places[of == 0][-1] >= len(text) - winnow.GUARANTEE
