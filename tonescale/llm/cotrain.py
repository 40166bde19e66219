"""Quality of documents by co-training on two views.

One logistic classifier sees the words of a text, another its page metadata: source, language, length. Each is fitted
on the labelled rows; then, over some rounds, each labels the unlabelled rows it is surest of, and the other one learns
from these beside the true labels. At the end each view is calibrated on labelled rows that neither was
fitted on, and a logistic combination of both calibrated views scores every document.

Of the labelled rows at most ``PER_CLASS`` distinct ids of each kind and target, chosen by a hash of the id, are fitted on; a
rare kind is taken whole, kinds weigh the same in the views, and calibration weighs them by their counts in all
labels. Every unlabelled row is looked at in every round: all are scored, and the surest of each kind are found by a distributed
top-k over ids and probabilities. Features of the chosen rows alone, not their texts, go to the driver. Scoring covers all texts, whole.

Defined results: a null or empty text has no words, null metadata are a value of their own. Rows without a label, with a null
label or a null id are unlabelled, those with a null id are not learned from. A repeated row is learned from once (of different rows of one labelled id, the one of the smallest hash),
and each gets its own result. Other columns are ignored. If no labels, or labels of one kind only, are given, all scores are
their share (0.5 without any). An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.llm.text import SPACE_CUT_LOWER, cut_words, pieces, texts_of
from tonescale.session import materialize

PER_CLASS = 1000
ROUNDS = 3
#: Rows of each kind that a view labels for the other in a round, and the probability it needs.
GIVEN = 200
SURE = 0.9
BUCKETS = 1 << 14
META = 128
STEPS = 60
_MARKS = ".,;:!?\"'()[]{}*#$%&|<>"


def _bucket(word: str) -> int:
    core = word.strip(_MARKS)
    return zlib.crc32(("w" + core if core else "m").encode()) % BUCKETS


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ends, features, values)`` of each text: hashed words by the logarithm of their count, and the shares of marks and capitals, of norm 1."""
    words, ends = cut_words(texts, SPACE_CUT_LOWER)
    size = len(texts)
    if len(words):
        coded = words.dictionary_encode()
        buckets = np.array([_bucket(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    else:
        buckets = np.zeros(0, np.int64)
    counts = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(size), counts)
    keys, n = np.unique(row * BUCKETS + buckets, return_counts=True)
    owner, feature, value = keys // BUCKETS, keys % BUCKETS, 1 + np.log(n)
    norm = np.sqrt(np.bincount(owner, value * value, size))
    return np.searchsorted(owner, np.arange(size), side="right"), feature, value / np.maximum(norm[owner], 1e-12)


def meta_features(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Six numbers per row: buckets of source, language and both, and of the length on three scales."""
    out = np.zeros((batch.num_rows, 6), np.int64)
    sources, langs, lengths = (batch.column(first + i).to_pylist() for i in range(3))
    for r, (s, g, n) in enumerate(zip(sources, langs, lengths)):
        log = -1.0 if n is None else float(np.log2(max(n, 1)))
        for k, name in enumerate((f"s{s}", f"l{g}", f"b{s}/{g}", f"n{int(log)}", f"m{int(2 * log)}", f"o{int(log / 2)}")):
            out[r, k] = zlib.crc32(name.encode()) % META
    return out


@dataclass
class Sparse:
    ends: np.ndarray
    features: np.ndarray
    values: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        # A row's sum does not depend on the rows beside it: equal rows are equally sure wherever they lie.
        return np.bincount(self.rows(), self.values * w[self.features], len(self.ends))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, size: int, steps: int = STEPS, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights, the last one for the constant; rows of weight 0 do not count."""
    w, rows = np.zeros(size + 1), x.rows()
    m, v = np.zeros_like(w), np.zeros_like(w)
    scaled = weight / max(weight.sum(), 1e-12)
    for step in range(1, steps + 1):
        g = scaled * (_sigmoid(x.dot(w) + w[-1]) - y)
        grad = np.bincount(x.features, x.values * g[rows], size + 1) + decay * w / 10
        grad[-1] = g.sum()
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def _dense_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-2, steps: int = 30) -> np.ndarray:
    """A few coefficients and a constant, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = _sigmoid(a @ w)
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + decay * np.eye(len(w))
        w -= np.linalg.solve(hessian, a.T @ (weight * (p - y)) + decay * w)
    return w


@dataclass
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    calibration: list[np.ndarray]
    combination: np.ndarray
    share: float | None

    def views(self, text: Sparse, meta: Sparse) -> np.ndarray:
        """Calibrated log-odds of both views."""
        raw = (text.dot(self.text) + self.text[-1], meta.dot(self.meta) + self.meta[-1])
        return np.stack([c[0] * r + c[1] for c, r in zip(self.calibration, raw)], 1)

    def score(self, text: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray]:
        if self.share is not None:
            flat = np.full(len(text.ends), self.share)
            return flat, np.stack([flat, flat], 1)
        both = self.views(text, meta)
        return _sigmoid(both @ self.combination[:2] + self.combination[2]), _sigmoid(both)


@dataclass
class Learner:
    """What one target has learned from so far: labelled rows, and the rows that each view was given by the other."""

    y: np.ndarray
    fold: np.ndarray
    totals: np.ndarray
    text: Sparse
    meta: Sparse

    def __post_init__(self) -> None:
        self.given: list[dict[int, tuple[float, tuple]]] = [{}, {}]
        self.found: list[np.ndarray] = []

    @property
    def usable(self) -> bool:
        return all(((self.y == kind) & (self.fold != 0)).any() for kind in (0, 1))

    def prior(self) -> float:
        """Log-odds of the kinds in all labels: the views are fitted on equal shares."""
        return float(np.log(self.totals[1] / self.totals[0]))

    def fit_views(self) -> None:
        known = self.fold != 0
        share = np.array([0.5 / max((known & (self.y == kind)).sum(), 1) for kind in (0, 1)])
        weight = np.where(known & (self.y >= 0), share[np.maximum(self.y, 0)], 0.0) * (known & (self.y >= 0)).sum()
        self.found = []
        for own, (x, size) in enumerate(((self.text, BUCKETS), (self.meta, META))):
            rows = [(f, v) if own == 0 else (m, np.ones(len(m))) for _, (f, v, m) in self.given[own].values()]
            labels = np.concatenate([np.maximum(self.y, 0), [kind for kind, _ in self.given[own].values()]]).astype(float)
            # What was guessed counts less than what is known.
            weights = np.concatenate([weight, np.full(len(rows), 0.5)])
            self.found.append(logistic(_joined(x, rows), labels, weights, size))

    def finish(self) -> CoTrained:
        at = (self.y >= 0) & (self.fold == 0)
        if not all((at & (self.y == kind)).any() for kind in (0, 1)):
            at = self.y >= 0  # too few of a kind to keep some apart
        target = self.y[at].astype(float)
        weight = np.where(target == 1, self.totals[1] / target.sum(), self.totals[0] / (1 - target).sum())
        weight *= len(target) / weight.sum()
        raw = [(x.dot(w) + w[-1])[at] for x, w in zip((self.text, self.meta), self.found)]
        model = CoTrained(*self.found, [_dense_logistic(r[:, None], target, weight) for r in raw], np.zeros(3), None)
        model.combination = _dense_logistic(model.views(self.text, self.meta)[at], target, weight)
        return model


def _joined(x: Sparse, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
    if not rows:
        return x
    ends = (x.ends[-1] if len(x.ends) else 0) + np.cumsum([len(f) for f, _ in rows])
    parts = [np.concatenate([first, *more]) for first, more in zip((x.features, x.values), zip(*rows))]
    return Sparse(np.concatenate([x.ends, ends]), *parts)


def _rows(docs: DataFrame, id_column: str, text: str, source: str, lang: str, length: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"), F.col(length).cast("long").alias("length"),
    )


def _views(batch: pa.RecordBatch) -> tuple[Sparse, Sparse]:
    meta = meta_features(batch, 2)
    return Sparse(*text_features(texts_of(batch.column(1)))), Sparse(6 * np.arange(1, len(meta) + 1), meta.ravel(), np.ones(meta.size))


def _fetched(rows: DataFrame, keys: list[int]) -> dict[int, tuple]:
    """Features of the rows of these keys, by key."""
    chosen = rows.sparkSession.createDataFrame([(k,) for k in keys], "h long")

    def run(batches):
        for batch in pieces(batches, 1):
            text, meta = _views(batch)
            ends = pa.array(np.concatenate([[0], text.ends]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (text.features, text.values)]
            yield pa.record_batch([batch.column(5), *lists, pa.array(meta.features.reshape(-1, 6).tolist(), pa.list_(pa.int64()))], ["h", "f", "v", "m"])

    picked = rows.join(F.broadcast(chosen), "h", "left_semi").select("id", "text", "source", "lang", "length", "h")
    made = picked.mapInArrow(run, "h long, f array<long>, v array<double>, m array<long>").dropDuplicates(["h"]).toArrow()
    columns = [made.column(c) for c in ("h", "f", "v", "m")]
    return {h.as_py(): tuple(x.values.to_numpy() for x in lists) for h, *lists in zip(*columns)}


def _of(keys: list[int], fetched: dict[int, tuple]) -> tuple[Sparse, Sparse]:
    none = Sparse(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return _joined(none, [fetched[k][:2] for k in keys]), _joined(none, [(fetched[k][2], np.ones(6)) for k in keys])


def _probabilities(rows: DataFrame, learners: dict[str, Learner]) -> DataFrame:
    """``(id, h, p0, p1, ...)``: of every row with an id, what each view of each target thinks."""
    views = rows.sparkSession.sparkContext.broadcast([(w, m.prior()) for m in learners.values() for w in m.found])
    kind, names = rows.schema["id"].dataType.simpleString(), [f"p{i}" for i in range(2 * len(learners))]

    def run(batches):
        for batch in pieces(batches, 1):
            both = _views(batch)
            found = [_sigmoid(both[i % 2].dot(w) + w[-1] + prior) for i, (w, prior) in enumerate(views.value)]
            yield pa.record_batch([batch.column(0), batch.column(5), *map(pa.array, found)], ["id", "h", *names])

    known = rows.filter("id is not null").select("id", "text", "source", "lang", "length", "h")
    return known.mapInArrow(run, f"id {kind}, h long, " + ", ".join(f"{n} double" for n in names))


def fit(
    rows: DataFrame, labels: DataFrame, targets: list[str], per_class: int = PER_CLASS, rounds: int = ROUNDS, given: int = GIVEN, sure: float = SURE
) -> dict[str, CoTrained]:
    """One pair of classifiers for each 0/1 column of ``labels`` (key ``id``)."""
    marks = labels.filter(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(F.col(t).cast("int")).alias(t) for t in targets])
    kinds = [(t, kind) for t in targets for kind in (0, 1)]
    totals = np.array(marks.agg(*[F.count_if(F.col(t) == kind) for t, kind in kinds]).first()).reshape(-1, 2)
    rows = rows.withColumn("h", F.xxhash64("id", "text", "source", "lang", "length"))
    order = F.xxhash64("id", F.lit("co-training"))
    some = [marks.filter(F.col(t) == kind).select("id", *targets, order.alias("order")).orderBy("order", "id").limit(per_class) for t, kind in kinds]
    # At most ``per_class`` for each kind and target.
    sampled = materialize(reduce(DataFrame.unionByName, some).distinct(), "labelled")
    one = rows.select("id", "h").join(F.broadcast(sampled), "id").groupBy("id", "order", *targets).agg(F.min("h").alias("h"))
    labelled = sorted(one.collect(), key=lambda r: (r["order"], r["h"]))
    keys = [r["h"] for r in labelled]
    fetched = _fetched(rows, keys) if keys else {}
    learners, models = {}, {}
    for t, total in zip(targets, totals):
        y = np.array([-1 if r[t] is None else r[t] for r in labelled], np.int64)
        fold = np.ones(len(y), np.int64)
        for kind in (0, 1):
            # Every fifth row of a kind, if it has two, is for calibration alone.
            own = np.flatnonzero(y == kind)
            fold[own[1::5]] = 0
        learner = Learner(y, fold, np.maximum(total, 1), *_of(keys, fetched))
        if total.min() and learner.usable:
            learner.fit_views()
            learners[t] = learner
        else:
            share = float(total[1] / total.sum()) if total.sum() else 0.5
            models[t] = CoTrained(np.zeros(BUCKETS + 1), np.zeros(META + 1), [], np.zeros(3), share)
    for _ in range(rounds if learners else 0):
        thin = materialize(_probabilities(rows, learners).join(marks.select("id"), "id", "left_anti").drop("id"), "sure")
        asked = []
        for i, (t, own) in enumerate((t, own) for t in learners for own in (0, 1)):
            # Rows that the other view was given before are no longer asked for; they are few.
            before = list(learners[t].given[1 - own])
            for kind in (0, 1):
                p = F.col(f"p{i}")
                enough = (p >= sure) if kind else (p <= 1 - sure)
                fresh = thin.filter(enough & ~F.col("h").isin(before) if before else enough).select("h", p.alias("p")).distinct()
                first = fresh.orderBy(F.desc("p") if kind else F.asc("p"), "h").limit(given)
                asked.append(first.select("h", F.lit(i).alias("view"), F.lit(kind).alias("kind")))
        found = reduce(DataFrame.unionByName, asked).collect()
        more = [h for h in dict.fromkeys(r["h"] for r in found) if h not in fetched]
        fetched |= _fetched(rows, more) if more else {}
        names = list(learners)
        for r in sorted(found, key=lambda r: (r["view"], -r["kind"], r["h"])):
            learners[names[r["view"] // 2]].given[1 - r["view"] % 2][r["h"]] = (float(r["kind"]), fetched[r["h"]])
        for learner in learners.values():
            learner.fit_views()
    return {t: learners[t].finish() if t in learners else models[t] for t in targets}


def classify(
    docs: DataFrame, labels: DataFrame, targets: list[str], id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars"
) -> DataFrame:
    """``id_column`` and, for each target, ``<t>_score``, ``<t>_text`` and ``<t>_meta``: both views combined, and each alone."""
    rows = _rows(docs, id_column, text, source, lang, length)
    models = fit(rows, labels.select(F.col(id_column).alias("id"), *targets), targets)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = rows.schema["id"].dataType.simpleString()
    names = [f"{t}_{part}" for t in targets for part in ("score", "text", "meta")]

    def run(batches):
        for batch in pieces(batches, 1):
            views, columns = _views(batch), [batch.column(0)]
            for t in targets:
                score, parts = shared.value[t].score(*views)
                columns += [pa.array(score), pa.array(parts[:, 0].copy()), pa.array(parts[:, 1].copy())]
            yield pa.record_batch(columns, ["id", *names])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("id", id_column)


def quality_verdict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores for quality and toxicity, and whether the document is kept: more likely good than not, and not likely toxic."""
    found = classify(docs, labels, ["quality", "toxic"])
    return found.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))
