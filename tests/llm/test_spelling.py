"""Spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tonescale.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "word", "n", "id") for i, t in rows], SCHEMA)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    found = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(found, key=str)


def random_rows(seed, letters, n=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]

    def varied(word):
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]]) or "x"
        return word.capitalize() if rng.random() < 0.2 else word

    rows = [(i, " ".join(varied(rng.choice(base)) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return rows + [(None, rows[0][1]), (None, None), (1, ""), (1, "4 5 !"), (2, "ÀÉÿ×÷ ÀÉÿ×÷, ÀÉÿ×÷-Straße " * 5), (3, "Ωmega naïveÉ\nnaïveé naïveÉ " * 4)]


@pytest.mark.parametrize("letters, size", [("abc", 8192), ("abc", 7), ("ab", 40), ("abcdefghijklmnopqrstuvwxyzéÿ", 16)])
def test_variants_against_all_pairs(spark, letters, size):
    rows = random_rows(len(letters) + size, letters)
    got = sorted((tuple(r) for r in spelling.variants(table(spark, rows).repartition(3), size=size).collect()), key=str)
    assert got == plain(rows)


def test_one_beginning_for_all_words_is_spread_over_indexes(spark):
    rng = random.Random(8)
    words = sorted({"prefix" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(300)})
    vocabulary = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    placed = spelling._placed(vocabulary, 20).filter("NOT asks").groupBy("bucket").count().collect()
    assert max(r["count"] for r in placed) < 80
    rows = [(i, " ".join(words)) for i in range(4)]
    got = sorted((tuple(r) for r in spelling.variants(table(spark, rows), size=20).collect()), key=str)
    assert got == plain(rows)


def test_search_finds_every_edit_in_the_other_half():
    rng = random.Random(2)
    for letters in ("ab", "abcÿ"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(250)})
        asked = words[::2] + ["zz" + words[0], words[1] + "q", words[2][:1] + "q" + words[2][1:]]
        index = spelling.Index(words)
        for first in (True, False):
            got = [(asked[i], words[j]) for i, j in zip(*spelling.search(index, asked, first))]
            want = {(a, b) for a in asked for b in words if one_edit(a, b) and (b.startswith(a[: len(a) // 2]) if first else b.endswith(a[len(a) // 2 :]))}
            assert len(got) == len(set(got)) and set(got) == want


def test_long_chains_long_words_and_empty_tables(spark):
    # Each word is a form of the one before, of twice its count.
    chain = ["aaaaaaa"[: 7 - i] + "bbbbbbb"[:i] for i in range(7)]
    rows = [(0, " ".join(w for k, w in enumerate(chain) for _ in range(3 << k)) + " " + " ".join(["x" * 5000, "x" * 5001] * 4))]
    got = sorted((tuple(r) for r in spelling.variants(table(spark, rows)).collect()), key=str)
    assert got == plain(rows) and {r[2] for r in got if r[0] in chain} == {chain[-1]}
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None), (2, "few words here")])).columns == ["word", "form", "root", "n", "n_near", "form_n"]
