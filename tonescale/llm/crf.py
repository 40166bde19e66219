"""Language of words and texts by a linear-chain conditional random field.

Every word has features: its prefixes and suffixes, character trigrams, itself, its shape, and the language in whose
learned lexicon it is. The field has a weight for each feature and language and one for each transition, learned together
by the exact likelihood gradient from forward and backward sums. Half of the training sequences are spliced from
texts of two languages, so transitions are learned from code-switched text. A word's label is the largest marginal of forward-backward;
a text's language has the largest sum of marginals over all its words. Chains have at most ``CHAIN`` words: a longer text is
several chains, each with all its words.

Only the text is an input of a prediction. The field is fitted on at most ``PER_LANGUAGE`` different texts of each language, of those
that are not held out, chosen by a hash of the text, so a rare language has all its texts in it and a text with many copies is in it once; from each,
chains spread evenly over the whole text are taken. Everything after that covers all texts.

Defined results: a null text and one without a letter are ``und`` with score 0; so are all texts if nothing could be learned. Repeated rows and
rows with a null id each get their own row; a null id counts as an empty one when it decides what is held out. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonescale.llm.text import SPACE_CUT, cut_words, gather, pieces, texts_of
from tonescale.session import materialize

PER_LANGUAGE = 500
CHAIN = 64
#: Words of a training chain, and chains taken from one text.
TRAIN_CHAIN = 24
CHAINS_PER_TEXT = 4
BUCKETS = 1 << 15
STEPS = 40
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|/\\=+-_~`@^0123456789"


def held_out(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def form(word: str) -> str:
    """What the features of a word depend on: its lower-case core, marked if the word has capitals only."""
    core = word.strip(_MARKS).lower()
    return "^" + core if word.isupper() else core


def features(word_form: str) -> list[int]:
    """Hashed features of a form; bucket 0 is the shape of words without letters."""
    core = word_form.removeprefix("^")
    if not any(c.isalpha() for c in core):
        return [0]
    names = ["w" + core, "s" + ("A" if word_form[0] == "^" else "a")]
    names += ["p" + core[:n] for n in (1, 2, 3, 4) if len(core) >= n]
    names += ["e" + core[-n:] for n in (1, 2, 3, 4) if len(core) >= n]
    padded = f"^{core}$"
    names += ["g" + padded[i : i + 3] for i in range(len(padded) - 2)]
    names += ["c" + c for c in {c for c in core if c > "\x7f"}]
    return [1 + zlib.crc32(n.encode()) % (BUCKETS - 1) for n in dict.fromkeys(names)]


def _flat(forms: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the forms, one after the other, and how many each has. Lexicon features follow the hashed ones."""
    found = []
    for w in forms:
        f = features(w)
        label = lexicon.get(w.removeprefix("^"))
        found.append(f if label is None else [*f, BUCKETS + label])
    n = np.array([len(f) for f in found], np.int64)
    return np.fromiter((i for f in found for i in f), np.int64, n.sum()), n


def emissions(forms: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """One score per form and label: the mean of its features' weights, scaled by the root of their number."""
    if not forms:
        return np.zeros((0, weights.shape[1]))
    flat, n = _flat(forms, lexicon)
    return np.add.reduceat(weights[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, with_pairs: bool = True):
    """Of chains (chain, position, label): marginals, pair marginals summed over all chains (if asked for), and log partition sums.

    Chains are padded at the end; positions beyond a chain's length have marginals 0.
    """
    chains, size, labels = scores.shape
    step = np.exp(transitions)
    live = np.arange(size)[None, :] < lengths[:, None]
    top = scores.max(2, keepdims=True)
    local = np.where(live[:, :, None], np.exp(scores - top), 1.0)
    alpha, scale = np.empty_like(local), np.ones((chains, size))
    now = local[:, 0]
    for t in range(size):
        if t:
            now = np.where(live[:, t, None], (now @ step) * local[:, t], now)
        scale[:, t] = now.sum(1)
        now = now / scale[:, t, None]
        alpha[:, t] = now
    beta = np.ones_like(local)
    for t in range(size - 2, -1, -1):
        back = (beta[:, t + 1] * local[:, t + 1]) @ step.T / scale[:, t + 1, None]
        beta[:, t] = np.where(live[:, t + 1, None], back, 1.0)
    marginals = np.where(live[:, :, None], alpha * beta, 0.0)
    marginals /= np.maximum(marginals.sum(2, keepdims=True), 1e-300)
    pairs = np.zeros((labels, labels))
    if with_pairs and size > 1:
        ahead = np.where(live[:, 1:, None], local[:, 1:] * beta[:, 1:] / scale[:, 1:, None], 0.0)
        pairs = np.einsum("cti,ctj->ij", alpha[:, :-1], ahead) * step
    log_z = np.where(live, np.log(scale) + top[:, :, 0], 0.0).sum(1)
    return marginals, pairs, log_z


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]


def training_chains(plain: list[tuple[list[str], int]], seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Words and labels of chains of one language each, and of as many that are spliced from two of them."""
    rng = np.random.default_rng(seed)
    chains = [(w, [k] * len(w)) for w, k in plain]
    for i, j in zip(rng.permutation(len(plain)), rng.permutation(len(plain))):
        (a, x), (b, y) = plain[i], plain[j]
        m, n = int(rng.integers(1, len(a) + 1)), int(rng.integers(1, len(b) + 1))
        chains.append((a[:m] + b[:n], [x] * m + [y] * n))
    return chains


def _lexicon(chains, n_labels: int) -> dict[str, int]:
    """Words that occur mostly in one language, from the chains of one text."""
    counts: dict[str, np.ndarray] = {}
    for words, labels in chains:
        for w, k in zip(words, labels):
            core = w.strip(_MARKS).lower()
            if core:
                counts.setdefault(core, np.zeros(n_labels))[k] += 1
    return {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() >= 0.9 * c.sum()}


def fit_chains(chains, labels: list[str], steps: int = STEPS, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximises the likelihood of the labels of all chains, by Adam on the whole gradient."""
    n_labels = len(labels)
    lexicon = _lexicon(chains, n_labels)
    number: dict[str, int] = {}
    size = max(len(w) for w, _ in chains)
    code, gold = np.zeros((len(chains), size), np.int64), np.zeros((len(chains), size), np.int64)
    lengths = np.array([len(w) for w, _ in chains])
    for i, (words, ks) in enumerate(chains):
        code[i, : len(words)] = [number.setdefault(form(w), len(number)) for w in words]
        gold[i, : len(ks)] = ks
    flat, n = _flat(list(number), lexicon)
    live = np.arange(size)[None, :] < lengths[:, None]
    word = np.repeat(np.arange(len(n)), n)
    root = 1 / np.sqrt(n)
    gold_word = np.bincount(code[live] * n_labels + gold[live], minlength=len(n) * n_labels).reshape(-1, n_labels)
    both = live[:, 1:]
    gold_pairs = np.bincount(gold[:, :-1][both] * n_labels + gold[:, 1:][both], minlength=n_labels**2).reshape(n_labels, -1)
    w, t = np.zeros((BUCKETS + n_labels, n_labels)), np.zeros((n_labels, n_labels))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    total = live.sum()
    for step in range(1, steps + 1):
        each = np.add.reduceat(w[flat], np.cumsum(n) - n, axis=0) * root[:, None]
        marginals, pairs, _ = forward_backward(each[code], t, lengths)
        expected = np.stack([np.bincount(code[live], marginals[:, :, k][live], len(n)) for k in range(n_labels)], 1)
        per_word = (gold_word - expected) * root[:, None] / total
        gw = np.stack([np.bincount(flat, per_word[word, k], len(w)) for k in range(n_labels)], 1) - decay * w / len(w)
        gt = (gold_pairs - pairs) / total
        for x, g, m, v in ((w, gw, *moments[:2]), (t, gt, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Field(labels, w, t, lexicon)


def _chosen(rows: DataFrame, per_language: int) -> DataFrame:
    """``(h, lang)`` of the texts of the smallest hashes in each language: at most ``per_language`` of each.

    Languages are counted first. Of each, the texts below a share of all hashes that some three times as many fall under go
    on, so however frequent a language is, only so few of its rows are ever put in order.
    """
    texts = rows.select("h", "lang").distinct()
    share = F.least(F.lit(1.0), F.lit(3.0 * per_language) / F.col("n"))
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"))
    few = texts.join(F.broadcast(counts), "lang").filter((F.col("h") / F.lit(2.0**64) + 0.5) <= share)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return few.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("h", "lang")


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Field | None:
    """Learns from texts and languages of rows that are not held out; None if there are none."""
    train = F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2
    rows = docs.filter(train).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    # Hashes only are ordered; the chosen texts, a bounded number for each language, follow by a join.
    chosen = materialize(_chosen(rows, per_language), "sample")
    spread = F.greatest(F.lit(1), F.size("words") - TRAIN_CHAIN)
    cut = F.expr(f"transform(sequence(0, {CHAINS_PER_TEXT - 1}), i -> slice(words, cast(1 + floor(i * s / {max(1, CHAINS_PER_TEXT - 1)}) as int), {TRAIN_CHAIN}))")
    words = rows.join(F.broadcast(chosen), ["h", "lang"]).select("h", "lang", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    found = words.withColumn("s", spread).select("h", "lang", cut.alias("chains")).dropDuplicates(["h", "lang"]).collect()
    found = sorted(found, key=lambda r: (r["h"], r["lang"]))
    labels = sorted({r["lang"] for r in found})
    plain = [(c, labels.index(r["lang"])) for r in found for c in r["chains"] if c]
    return fit_chains(training_chains(plain), labels) if plain else None


class Labeller:
    """Applies a field to batches; the scores of the forms seen last are kept."""

    KEPT = 300_000

    def __init__(self, field: Field) -> None:
        self.field = field
        self._clear()

    def _clear(self) -> None:
        self._row: dict[str, int] = {}
        self._parts: list[np.ndarray] = []

    def _scores(self, words: list[str]) -> np.ndarray:
        forms = [form(w) for w in words]
        new = list(dict.fromkeys(f for f in forms if f not in self._row))
        if len(self._row) + len(new) > self.KEPT:
            self._clear()
            new = list(dict.fromkeys(forms))
        if new:
            first = len(self._row)
            self._row.update((f, first + i) for i, f in enumerate(new))
            self._parts = [np.concatenate([*self._parts, emissions(new, self.field.weights, self.field.lexicon)])]
        return self._parts[0][[self._row[f] for f in forms]]

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(marginals, ends)``: one row per word, and after how many words each text ends."""
        words, ends = cut_words(texts, SPACE_CUT)
        if not len(words):
            return np.zeros((0, len(self.field.labels))), ends
        coded = words.dictionary_encode()
        scores = self._scores(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        counts = np.diff(ends, prepend=0)
        n = -(-counts // CHAIN)
        chain = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(ends - counts, n) + chain * CHAIN
        lengths = np.minimum(CHAIN, np.repeat(counts, n) - chain * CHAIN)
        out = np.empty((len(words), len(self.field.labels)))
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            size = lengths[part]
            place = starts[part][:, None] + np.minimum(np.arange(size.max())[None, :], size[:, None] - 1)
            found = forward_backward(scores[codes[place]], self.field.transitions, size, with_pairs=False)[0]
            out[gather(starts[part], size)] = found[np.arange(size.max())[None, :] < size[:, None]]
        return out, ends


def predict(docs: DataFrame, field: Field | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_column, held_out, lang_pred, score)`` of every text; the score is the mean marginal of the predicted language."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        labeller = Labeller(shared.value) if shared.value else None
        for batch in pieces(batches, 1):
            texts, size = texts_of(batch.column(1)), batch.num_rows
            held = pa.array([held_out(i) for i in batch.column(0).to_pylist()])
            spoken = np.array([any(c.isalpha() for c in t) for t in texts.to_pylist()], bool)
            names, score = np.full(size, "und", object), np.zeros(size)
            if labeller and spoken.any():
                found, ends = labeller.marginals(texts)
                sums = np.vstack([np.zeros(found.shape[1]), np.cumsum(found, axis=0)])
                mean = np.diff(sums[ends], axis=0, prepend=sums[:1]) / np.maximum(np.diff(ends, prepend=0), 1)[:, None]
                best = mean.argmax(1)
                names = np.where(spoken, np.array(labeller.field.labels, object)[best], names)
                score = np.where(spoken, np.clip(mean[np.arange(size), best], 0, 1), 0.0)
            yield pa.record_batch([batch.column(0), held, pa.array(names.tolist(), pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_column)


def label_words(docs: DataFrame, field: Field, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_column, nth, word, lang, p)``: the label of every word of code-switched texts, and its marginal."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        labeller = Labeller(shared.value)
        for batch in pieces(batches, 1, 1 << 20):
            texts = texts_of(batch.column(1))
            words, _ = cut_words(texts, SPACE_CUT)
            found, ends = labeller.marginals(texts)
            counts = np.diff(ends, prepend=0)
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            nth = np.arange(len(words)) - np.repeat(ends - counts, counts)
            names = pa.array(labeller.field.labels).take(pa.array(found.argmax(1)))
            yield pa.record_batch([owner, pa.array(nth), words, names, pa.array(found.max(1, initial=0.0))], ["id", "nth", "word", "lang", "p"])

    return rows.mapInArrow(run, f"id {kind}, nth long, word string, lang string, p double").withColumnRenamed("id", id_column)
