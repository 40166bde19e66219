"""Vector codes against comparing every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from tonescale.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "id", "x", "code") for i, v, k in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    seeds = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in seeds] for p in range(parts)]

    def choose():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], y)), e) for e, y in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        found = choose()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[r][p] for r in range(len(cut)) if found[r][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found, sums = choose(), {}
    error = [sum(d for d, _ in f) for f in found]
    for (_, _, k), e in zip(kept, error):
        sums[k] = sums.get(k, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for y in book for c in y).encode()).hexdigest()
    rows = [(i, "".join(f"{e:02x}" for _, e in f), x, sums[k], digest) for (i, _, k), f, x in zip(kept, found, error)]
    return sorted(rows, key=str)


def random_rows(n, width, seed=3):
    rng = random.Random(seed)
    # Few different values: ties in distances and in sums.
    return [(i, [np.float32(rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3, rng.gauss(0, 0.2)])).item() for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n, width", [(150, 64), (20, 16), (90, 48)])
def test_codes_against_full_search(spark, n, width):
    rows = random_rows(n, width)
    rng = random.Random(n)
    rng.shuffle(rows)
    odd = [(900, None, 1), (901, [1.0] * (width - 1) + [None], 1), (-5, [float("nan")] * width, 2), (903, [float("inf")] + [0.0] * (width - 1), None)]
    odd += [(904, [], 1), (905, [0.5] * 32 if width != 32 else [0.5], 1), (906, [0.5] * 5, 2)]
    repeated = [rows[0], rows[0], (rows[1][0], rows[2][1], 1), (None, rows[3][1], None)]
    usable = rows + repeated
    got = sorted((tuple(r) for r in vectors.compress(table(spark, usable + odd)).collect()), key=str)
    assert got == plain(usable)


def test_search_sees_every_entry_that_could_be_nearest():
    rng = np.random.default_rng(5)
    for width in (1, 2, 4, 7):
        points, entries = rng.integers(-6, 7, (500, width)), rng.integers(-6, 7, (40, width))
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        chosen, distance = vectors.nearest(points, entries)
        assert (chosen == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_large_components_empty_tables_and_many_labels(spark):
    huge = [(i, [float(s) * 3e38] * 16, i) for i, s in enumerate([1, -1, 0])]
    got = vectors.compress(table(spark, huge)).collect()
    assert [r["error"] for r in got] == [0, 0, 0] and len({r["code"] for r in got}) == 3
    assert vectors.compress(table(spark, [])).count() == 0
    assert vectors.compress(table(spark, [(1, None, 1), (2, [1.0] * 15, 1)])).count() == 0
    coded = spark.createDataFrame([(i, -7 if i % 3 == 0 else i if i % 3 == 1 else None, "00", i) for i in range(6000)], "id long, label long, code string, error long")
    few, many = (sorted(tuple(r) for r in vectors.with_label_errors(coded, small).select("id", "label_error").collect()) for small in (10_000, 10))
    assert few == many and len(few) == 6000
    assert dict(few)[3] == sum(i for i in range(6000) if i % 3 == 0) and dict(few)[2] == sum(i for i in range(6000) if i % 3 == 2)


def test_codes_stand_for_vectors_near_their_own(spark):
    rows, length = vectors.integers(table(spark, random_rows(100, 32)))
    books = vectors.fit(rows, length, parts=16, entries=64)
    back = vectors.decode(vectors.encode(rows, books), books).join(rows, "id").collect()
    for r in back:
        gap = np.array(r["vector"]) * 256 - 0.5 - np.array(r["x"])
        assert round(float((gap**2).sum())) == r["error"]
