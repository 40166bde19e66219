"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and stores, beside the measurements, one bit for
each rule that fails. A policy is a named, versioned set of rules: applying one, or
another version of it, is a bitwise test of the stored bits. ``ablation`` counts, from
the distinct bit patterns, what each rule of a policy rejects alone.

Everything is a DataFrame expression over one row, so no text is shuffled and no group
of rows meets in a task, however often a source or a copy occurs.

Defined results: a null or empty text, or one without words, has measurements 0; its
``few_words`` bit is set. Repeated rows, and rows with a null id, each get their own row. Other
columns of the input are ignored, whatever their names. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; it is true where the rule rejects."""

    bit: int
    name: str
    fails: str


#: Bits are never given a new meaning: stored ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(3, "symbols", "n_symbols > n_words"),
    Rule(4, "short_or_long_words", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
    Rule(5, "digits", "2 * n_digits > word_chars"),
)

#: Policies by name and version: the rules that reject.
POLICIES: Mapping[str, Sequence[str]] = {
    "base@1": ("few_words", "repeated_windows"),
    "web@1": ("few_words", "repeated_windows", "repeated_lines", "symbols"),
    "web@2": tuple(r.name for r in RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits")


def _repeat_words(words: str) -> Column:
    """Words in windows that occur twice or more: equal windows lie side by side once sorted."""
    return F.expr(f"""
        aggregate(transform(array(sort_array(transform(array(sort_array(transform(
                sequence(1, size({words}) - {WINDOW - 1}),
                i -> struct(array_join(slice({words}, i, {WINDOW}), ' ') AS w, i AS i)
            ))), s -> transform(filter(s, (x, k) ->
                (k > 0 AND x.w = get(s, k - 1).w) OR (k + 1 < size(s) AND x.w = get(s, k + 1).w)
            ), x -> x.i))[0])), p -> aggregate(
                transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0, (a, b) -> a + b
            )), 0L, (a, b) -> a + b)
    """)


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and one long column for each of ``MEASURES``.

    Hashes of the windows of a text find the texts that have a repeated window at all;
    only in those are the windows themselves compared.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    texts = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("_text"))
    cut = texts.select(
        *names,
        F.coalesce("_text", F.lit("")).alias("_text"),
        F.array_remove(F.split(F.coalesce("_text", F.lit("")), _SPACES), "").alias("_words"),
        F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    hashed = cut.select(
        *names,
        "_text",
        "_words",
        "_lines",
        F.array_join("_words", "").alias("_joined"),
        F.when(
            F.size("_words") > WINDOW,
            F.expr(f"transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW})))"),
        ).alias("_windows"),
    )
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    found = (
        F.size("_words").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_windows").isNotNull() & repeats, _repeat_words("_words")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_joined", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    # As the rows of a one-element array: a later filter then sees the measurements and is not turned into
    # the expressions behind them, which would be evaluated once more for each mention.
    once = hashed.select(*names, F.struct(*found).alias("_found")).select(*names, F.inline(F.array("_found")))
    return once.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *MEASURES)


def fail_bits(rules: Sequence[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and ``fail_bits`` of every row: what policies are applied to."""
    return measure(docs, text, keep).withColumn("fail_bits", fail_bits(rules))


def mask(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    known = {r.name: 1 << r.bit for r in rules}
    return sum(known[n] for n in names)


def kept(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy fails, from the stored bits alone."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(stored: DataFrame, policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule of the policy: ``(rule, n_failed, n_only, n_kept, n_kept_without)``.

    ``n_only`` rows fail this rule and no other of the policy, so they are kept without it.
    At most 2^rules patterns are left after the first, map-side combined, aggregate.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = (
        stored.select(F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules)).cast("long")).alias("bits"))
        .groupBy("bits")
        .agg(F.count("*").alias("n"))
    )
    known = {r.name: 1 << r.bit for r in rules}
    single = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(known[n]).cast("long").alias("bit")) for n in names]))
    each = patterns.select("bits", "n", single.alias("r")).select("bits", "n", "r.rule", "r.bit")

    def count(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0).cast("long"))

    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(F.col("bits") == 0).alias("n_kept"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )


def passing(docs: DataFrame, policy: str | Sequence[str], text: str = "text") -> DataFrame:
    """The rows that the policy keeps, with all their columns."""
    # Whole rows travel as one column, so no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("_row"))
    stored = ledger(rows, f"_row.{text}", ["_row"])
    return stored.filter(kept(policy)).select("_row.*")
