"""Language model, language identification, quality classifier: exact sums and held-out accuracy."""

import contextlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tonescale.llm import cotrain, crf, katz

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, base string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "clash", "clash", "clash") for i, t, g, s in rows], SCHEMA)


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class PlainKatz:
    """The model in dictionaries."""

    def __init__(self, texts, size):
        trained = [t for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
        self.c = Counter(w for t in trained for w in tokens_of(t))
        self.n = sum(self.c.values())
        # Ties by the token's number, as the tables have it.
        number = {w: katz._END if w is None else int(katz._tokens(pa.array([w]))[0][0]) for w in self.c}
        self.words = set(sorted(self.c, key=lambda w: (-self.c[w], number[w]))[:size])
        self.pairs = Counter(p for t in trained for p in self.classes(tokens_of(t)))
        self.history = Counter()
        for (h, _), k in self.pairs.items():
            self.history[h] += k
        self.d1, self.d2 = (katz.discounts(Counter(x.values())) for x in (self.c, self.pairs))

    def kind(self, w):
        return w if w in self.words else "<other>"

    def classes(self, tokens):
        return [(self.kind(a), self.kind(b)) for a, b in zip([None, *tokens], tokens)]

    def less(self, d, c):
        return d[c] * c if c <= katz.CUT else c - katz.REST

    def unigram(self, w):
        return self.less(self.d1, self.c[w]) / self.n if self.c[w] else self.unknown()

    def unknown(self):
        return 1 - sum(self.less(self.d1, c) for c in self.c.values()) / self.n

    def lower(self, k):
        if k != "<other>":
            return self.unigram(k)
        return 1 - sum(self.unigram(w) for w in self.words)

    def p(self, h, w):
        h, k = self.kind(h), self.kind(w)
        share = 1.0 if k != "<other>" else self.unigram(w) / self.lower(k)
        seen = [(b, c) for (a, b), c in self.pairs.items() if a == h]
        if self.pairs[h, k]:
            everything = len(seen) == len(self.words) + 1
            whole = sum(self.less(self.d2, c) for _, c in seen) if everything else self.history[h]
            return share * self.less(self.d2, self.pairs[h, k]) / whole
        left = 1 - sum(self.less(self.d2, c) for _, c in seen) / self.history[h] if seen else 1.0
        return share * left / (1 - sum(self.lower(b) for b, _ in seen)) * self.lower(k)


def corpus(rng, n):
    words = [f"w{i}" for i in range(30)]
    texts = [None, "", "w1 W1 w1", "é È"]
    texts += [" ".join(words[min(int(rng.expovariate(0.2)), 29)] if rng.random() < 0.8 else f"x{rng.randrange(400)}" for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return list(enumerate(texts)) + [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2")]


@pytest.mark.parametrize("size, frequent", [(12, 8), (10_000, 100_000), (3, 0)])
def test_katz_against_dictionaries(spark, size, frequent):
    texts = corpus(random.Random(1), 120)
    docs = table(spark, [(i, t, "en", "s") for i, t in texts])
    model = katz.fit(docs, vocabulary=size, frequent=frequent)
    plain = PlainKatz(texts, size)
    got = katz.score(docs, model).collect()
    assert model.n == plain.n and model.types == len(plain.c) and len(got) == len(texts)
    want = {}
    for i, t in texts:
        tokens = tokens_of(t)
        base = sum(math.log10((plain.c[w] + 0.1) / (plain.n + 0.1 * (len(plain.c) + 1))) for w in tokens)
        score = sum(math.log10(plain.p(h, w)) for h, w in zip([None, *tokens], tokens))
        want.setdefault(i, []).append((len(tokens), sum(plain.c[w] > 0 for w in tokens), base, score))
    for r in got:
        assert any(
            (r["n_tokens"], r["n_known"]) == x[:2] and math.isclose(r["base_score"], x[2], rel_tol=1e-9) and math.isclose(r["score"], x[3], rel_tol=1e-6)
            for x in want[r["doc_id"]]
        ), (r, want[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0)
    for h in [None, "w1", "x3", "never seen"]:
        assert math.isclose(sum(plain.p(h, w) for w in plain.c) + plain.p(h, "unknown type"), 1, rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("local, frequent", [(12, 8), (0, 0), (10_000, 100_000)])
def test_katz_keeps_the_bigrams_of_all_words(spark, local, frequent):
    texts = corpus(random.Random(2), 120)
    docs, plain = table(spark, [(i, t, "en", "s") for i, t in texts]), PlainKatz(texts, 1 << 30)
    want = {}
    for i, t in texts:
        tokens = tokens_of(t)
        want.setdefault(i, []).append(sum(math.log10(plain.p(h, w)) for h, w in zip([None, *tokens], tokens)))
    got = katz.score(docs, katz.fit(docs, frequent=frequent, local=local)).collect()
    assert len(got) == len(texts)
    assert all(any(math.isclose(r["score"], x, rel_tol=1e-9) for x in want[r["doc_id"]]) for r in got)


@pytest.mark.parametrize("local, vocabulary", [(12, None), (0, None), (12, 12)])
def test_katz_does_not_depend_on_the_number_of_buckets(spark, monkeypatch, local, vocabulary):
    texts = corpus(random.Random(5), 150)
    docs = table(spark, [(i, t, "en", "s") for i, t in texts])
    one = katz.score(docs, katz.fit(docs, vocabulary=vocabulary, frequent=4, local=local)).collect()
    monkeypatch.setattr(katz, "PER_BUCKET", 60)
    model = katz.fit(docs, vocabulary=vocabulary, frequent=4, local=local)
    assert model.layout.buckets > 20
    many = katz.score(docs.repartition(5), model).collect()
    assert len(one) == len(many) == len(texts)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 6))
    for a, b in zip(sorted(one, key=key), sorted(many, key=key)):
        assert a[:5] == b[:5] and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9) and math.isclose(a["score"], b["score"], rel_tol=1e-9)


def test_katz_writes_few_files_however_many_partitions(spark, monkeypatch, tmp_path):
    texts = corpus(random.Random(6), 150)
    docs = table(spark, [(i, t, "en", "s") for i, t in texts])
    want = {r["doc_id"]: r["score"] for r in katz.score(docs, katz.fit(docs)).collect()}
    conf = {"spark.sql.shuffle.partitions": "70", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(katz, "scratch", lambda spark: contextlib.nullcontext())
    monkeypatch.setattr(katz, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["score"] for r in katz.score(docs, katz.fit(docs)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    files = {p.name: len(list(p.glob("part-*"))) for p in (tmp_path / "katz-counts").iterdir()}
    assert files and all(n <= katz.FILES * spark.sparkContext.defaultParallelism for n in files.values()), files


def test_katz_packed_numbers_and_look_ups():
    rng = np.random.default_rng(7)
    x = np.sort(rng.integers(0, 1 << 62, 500))
    f = rng.normal(size=300)
    assert (katz.unpack(katz.pack(x, True), True) == x).all() and (katz.unpack(katz.pack(f), kind=np.float64) == f).all()
    assert len(katz.unpack(katz.pack(x[:0], True), True)) == 0
    a, o, n = katz._summed(rng.integers(0, 9, 200), rng.integers(-1, 9, 200), np.ones(200, np.int64))
    pairs, want = katz._Pairs(a, o, n), dict(zip(zip(a.tolist(), o.tolist()), n.tolist()))
    asked = rng.integers(-2, 12, (2, 400))
    assert n.sum() == 200 and pairs.count(*asked).tolist() == [want.get(k, 0) for k in zip(*asked.tolist())]


def test_katz_tells_rare_words_apart_in_a_large_vocabulary(spark):
    many = " ".join(f"v{i} v{i}" for i in range(70_000))
    docs = table(spark, [(i, many, "en", "s") for i in (1, 2)] + [(3, "rare pair", "en", "s"), (4, "pair rare", "en", "s")])
    trained, asked = docs.filter("doc_id < 4"), docs.filter("doc_id > 2")
    score = {r["doc_id"]: r["score"] for r in katz.score(asked, katz.fit(trained)).collect()}
    assert score[3] > score[4] + 1


def test_katz_of_empty_tables(spark):
    docs = table(spark, [(1, "a b", "en", "s")])
    assert katz.score(docs.limit(0), katz.fit(docs)).count() == 0
    r = katz.score(docs, katz.fit(docs.limit(0))).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    scores, transitions, lengths = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 3])
    marginals, pairs, log_z = crf.forward_backward(scores, transitions, lengths)
    all_pairs = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        weights = {}
        for path in itertools.product(range(3), repeat=int(n)):
            s = sum(scores[c, t, k] for t, k in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
            weights[path] = math.exp(s)
        z = sum(weights.values())
        assert math.isclose(log_z[c], math.log(z))
        for t in range(n):
            for k in range(3):
                assert math.isclose(marginals[c, t, k], sum(w for p, w in weights.items() if p[t] == k) / z, abs_tol=1e-9)
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                all_pairs[a, b] += w / z
        assert (marginals[c, n:] == 0).all()
    assert np.allclose(pairs, all_pairs)


def spoken(rng, lang, n):
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["schr", "ung", "eit"], "cc": ["éux", "çon", "ée"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_on_held_out_and_switched_texts(spark):
    rng = random.Random(4)
    rows = [(i, spoken(rng, g, rng.randint(1, 300)), g, "s") for i in range(240) for g in [rng.choice(["aa", "bb", "cc"])]]
    odd = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 -- 3", "bb", None), (1003, spoken(rng, "aa", 20), None, None), (None, spoken(rng, "bb", 20), "bb", "s"), rows[0], rows[0]]
    docs = table(spark, rows + odd)
    field = crf.fit(docs)
    got = crf.predict(docs, field).collect()
    assert len(got) == len(rows) + len(odd) and field.labels == ["aa", "bb", "cc"]
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(by_id[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(by_id[r[0]]["held_out"] for r in held) and [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und"] * 3 + ["aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got) and by_id[1000]["score"] == 0
    mixed = spoken(rng, "aa", 12) + " " + spoken(rng, "cc", 12)
    labels = [r["lang"] for r in crf.label_words(table(spark, [(1, mixed, None, None)]), field).orderBy("nth").collect()]
    assert sum(a == b for a, b in zip(labels, ["aa"] * 12 + ["cc"] * 12)) >= 22
    none = docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang != ''")
    assert {r["lang_pred"] for r in crf.predict(docs, crf.fit(none)).collect()} == {"und"}
    assert crf.predict(docs.limit(0), field).count() == 0


def test_co_training_on_held_out_labels(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        good = rng.random() < 0.6
        words = [rng.choice(["fine", "clear", "well"] if good else ["spam", "buy", "now"]) if rng.random() < 0.2 else f"w{rng.randrange(50)}" for _ in range(rng.randint(5, 60))]
        source = rng.choice(["s1", "s2"]) if rng.random() < 0.3 else ("s3" if good else "s4")
        rows.append((i, " ".join(words), rng.choice(["en", None]), source))
        marks.append((i, int(good), 0 if rng.random() < 0.5 else None))
    odd = [(900, None, None, None), (901, "", None, None), (None, "spam", "en", "s4"), rows[0], rows[0]]
    docs = table(spark, rows + odd)
    labels = spark.createDataFrame([*marks[:120], (None, 1, 1), (1, marks[1][1], None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = cotrain.quality_verdict(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r["quality_score"] for r in got}
    right = [(by_id[i] >= 0.5) == bool(q) for i, q, _ in marks[120:]]
    assert sum(right) >= 0.9 * len(right)
    assert all(0 <= r["quality_score"] <= 1 and 0 <= r["toxic_score"] <= 1 for r in got)
    assert cotrain.quality_verdict(docs.limit(0), labels).count() == 0
    none = cotrain.quality_verdict(docs, labels.limit(0)).collect()
    assert {r["quality_score"] for r in none} == {0.5}


def labelled_rows(n, rare, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % (n // rare) == 7
        words = ["spam", "hate"] * 3 if toxic else []
        rows.append((i, " ".join([*words, *(f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 25)))]), rng.choice(["en", "de"]), "bad" if toxic and i % 2 else rng.choice(["s1", "s2"]), int(toxic)))
    return rows


def test_a_rare_kind_is_learned_from_whole(spark):
    rows = labelled_rows(6000, 6)
    docs = table(spark, [r[:4] for r in rows])
    labels = spark.createDataFrame([(i, 0, t) for i, *_, t in rows if i < 5000], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotrain.quality_verdict(docs, labels).collect()}
    toxic = [got[i]["toxic_score"] for i, *_, t in rows if t]
    clean = sorted((got[i]["toxic_score"] for i, *_, t in rows if not t), reverse=True)
    assert min(toxic) > 0.5 > clean[0] and {r["quality_score"] for r in got.values()} == {0.0}


def test_rounds_against_all_rows_in_memory(spark):
    rng = random.Random(7)
    rows = []
    for i in range(160):
        good = rng.random() < 0.5
        words = [("fine" if good else "spam") if rng.random() < 0.15 else f"w{rng.randrange(12)}" for _ in range(rng.randint(2, 20))]
        rows.append((i, " ".join(words), "en", "s3" if good and rng.random() < 0.7 else "s4", int(good)))
    docs = table(spark, [r[:4] for r in rows] + [rows[100][:4], (None, "fine", "en", "s3")])
    keyed = cotrain._rows(docs, "doc_id", "text", "source", "lang", "n_chars")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:50]], "id long, quality int")
    model = cotrain.fit(keyed, labels, ["quality"], per_class=20, rounds=3, given=7, sure=0.6)["quality"]

    # The same in memory: every unlabelled row is scored, sorted and handed over.
    hashed = keyed.selectExpr("*", "xxhash64(id, text, source, lang, length) h", "xxhash64(id, 'co-training') o").filter("id is not null").distinct().toPandas()
    both = cotrain._views(pa.RecordBatch.from_pandas(hashed[["id", "text", "source", "lang", "length"]], preserve_index=False))
    truth = {r[0]: r[4] for r in rows[:50]}
    order = sorted((o, i) for o, i in zip(hashed.o, hashed.id) if i in truth)
    picked = [i for k in (0, 1) for i in [i for _, i in order if truth[i] == k][:20]]
    chosen = [i for _, i in order if i in picked]
    at = {i: n for n, i in enumerate(hashed.id)}

    def only(x, wanted):
        first = np.concatenate([[0], x.ends[:-1]])
        return [(x.features[first[j] : x.ends[j]], x.values[first[j] : x.ends[j]]) for j in wanted]

    y = np.array([truth[i] for i in chosen])
    fold = np.ones(len(y), int)
    for k in (0, 1):
        fold[np.flatnonzero(y == k)[1::5]] = 0
    none = cotrain.Sparse(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    totals = np.bincount([truth[i] for i in truth], minlength=2)
    learner = cotrain.Learner(y, fold, totals, *(cotrain._joined(none, only(x, [at[i] for i in chosen])) for x in both))
    learner.fit_views()
    free = [n for n, i in enumerate(hashed.id) if i not in truth]
    for _ in range(3):
        raw = [1 / (1 + np.exp(-(both[v].dot(w) + w[-1] + learner.prior()))) for v, w in enumerate(learner.found)]
        for own in (0, 1):
            taken = set(learner.given[1 - own])
            for kind in (1, 0):
                sure = [n for n in free if hashed.h[n] not in taken and (raw[own][n] >= 0.6 if kind else raw[own][n] <= 0.4)]
                best = sorted(sure, key=lambda n: (-raw[own][n] if kind else raw[own][n], hashed.h[n]))[:7]
                for n in sorted(best, key=lambda n: hashed.h[n]):
                    (f, v), (m, _) = only(both[0], [n])[0], only(both[1], [n])[0]
                    learner.given[1 - own][hashed.h[n]] = (float(kind), (f, v, m))
        learner.fit_views()
    assert all(len(g) > 7 for g in learner.given)
    plain = learner.finish()
    assert np.allclose(model.score(*both)[0], plain.score(*both)[0], atol=1e-6)


def test_rare_languages_and_copies_in_the_sample(spark):
    rng = random.Random(9)
    rows = [(i, spoken(rng, "aa", 30), "aa", "s") for i in range(3000)] + [(5000, spoken(rng, "aa", 9), "aa", "s")] * 300
    rows += [(9000 + i, spoken(rng, "bb", 30), "bb", "s") for i in range(8)] + [(None, spoken(rng, "cc", 40), "cc", None)] * 3
    docs = table(spark, rows)
    field = crf.fit(docs, per_language=40)
    # A null id counts as an empty one, whose remainder is not that of a held-out row.
    assert field.labels == ["aa", "bb", "cc"]
    asked = [(1, spoken(rng, "bb", 25), None, None), (2, spoken(rng, "cc", 25), None, None), (3, spoken(rng, "aa", 25), None, None), (4, "kato" * 200, None, None)]
    assert {r["doc_id"]: r["lang_pred"] for r in crf.predict(table(spark, asked), field).collect()} == {1: "bb", 2: "cc", 3: "aa", 4: "aa"}


def test_long_words_have_all_their_trigrams():
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=80))
    assert len(crf.features(word)) > 60
