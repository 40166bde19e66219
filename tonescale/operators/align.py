"""Pairing predictions with gold annotations by id, by text or by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS
from tonescale.operators.position import numbered
from tonescale.session import materialize

Order = Sequence[Column | str]


def choose_key(preds: DataFrame, gold: DataFrame) -> str | None:
    """``id`` if both tables have it, else ``text``, else none (pair by position)."""
    for key in ("id", "text"):
        if key in preds.columns and key in gold.columns:
            return key
    return None


def _suffixed(preds: DataFrame, gold: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Mark columns that both sides have; a name that is then taken already is an error."""
    shared = (set(preds.columns) & set(gold.columns)) - {key}
    left = [f"{c}_pred" if c in shared else c for c in preds.columns]
    right = [f"{c}_gold" if c in shared else c for c in gold.columns if c != key]
    taken = sorted({c for c in left + right if (left + right).count(c) > 1})
    if taken:
        raise ValueError(f"column name(s) {taken} would appear twice in the aligned table")
    return preds.toDF(*left), gold.toDF(*[c if c == key else f"{c}_gold" if c in shared else c for c in gold.columns])


def key_of(key: str) -> Column:
    """What stands for the key in a shuffle: SHA-256 for a text, which may be long, else the key itself."""
    if key == "text":
        return F.unhex(F.sha2(F.col(key).cast("string"), 256))
    return F.col(key)


def _sides(preds: DataFrame, gold: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    left, right = _suffixed(preds, gold, key)
    return left.withColumn("__left", key_of(key)), right.withColumn("__right", key_of(key)).drop(key)


def _join(preds: DataFrame, gold: DataFrame, key: str, missing: str = "pair") -> DataFrame:
    left, right = _sides(preds, gold, key)
    same = F.col("__left") == F.col("__right") if missing == "drop" else F.col("__left").eqNullSafe(F.col("__right"))
    return left.join(right, same, "inner").drop("__left", "__right")


def align_spread(preds: DataFrame, gold: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """The rows of ``align`` by ``id`` or ``text`` where a few keys, or the missing ones, have very many rows.

    Keys are counted first. Those with more than ``most`` rows on one side, and the missing ones, of which there can be no more than
    the rows of both sides over ``most`` plus one, are broadcast: their rows leave the plain join before it shuffles. They
    are stored and numbered, each side is dealt by number into blocks of at most ``most`` rows, and every pair of blocks is a cell
    of its own, so no task gets more than a cell at a time, however the rows of the key lie. A side in one block is copied once for each block of the other.
    """
    left, right = _sides(preds, gold, key)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(F.col("__left").alias("__key"), one.alias("p"), none.alias("g")).unionByName(
        right.select(F.col("__right").alias("__key"), none.alias("p"), one.alias("g"))
    )
    counts = both.groupBy("__key").agg(F.sum("p").alias("p"), F.sum("g").alias("g")).filter("p > 0 AND g > 0")
    large = (F.col("p") > most) | (F.col("g") > most) | F.col("__key").isNull()
    blocks = [F.ceil(F.col(c) / most).cast("long").alias(n) for c, n in (("p", "__rows"), ("g", "__columns"))]
    crowded = materialize(counts.filter(large).select("__key", *blocks, F.monotonically_increasing_id().alias("__slot")), "crowded")
    known = F.broadcast(crowded.select("__key"))

    def others(side: DataFrame, name: str) -> DataFrame:
        return side.filter(F.col(name).isNotNull()).join(known, F.col(name) == F.col("__key"), "left_anti")

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        rows = side.join(F.broadcast(crowded), F.col(name).eqNullSafe(F.col("__key"))).drop("__key", name)
        stored = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "crowded")
        placed = stored.withColumn(f"{own}_at", F.pmod("__row", own))
        return placed.withColumn(f"{other}_at", F.explode(F.sequence(none, F.col(other) - 1))).drop("__row", "__rows", "__columns")

    plain = others(left, "__left").join(others(right, "__right"), F.col("__left") == F.col("__right")).drop("__left", "__right")
    if crowded.isEmpty():
        return plain
    cells = ["__slot", "__rows_at", "__columns_at"]
    spread = dealt(left, "__left", "__rows", "__columns").join(dealt(right, "__right", "__columns", "__rows"), cells).drop(*cells)
    return plain.unionByName(spread)


def align(
    preds: DataFrame,
    gold: DataFrame,
    how: str = "auto",
    order_preds: Order | None = None,
    order_gold: Order | None = None,
    missing: str = "pair",
) -> DataFrame:
    """One row per pair of a prediction and a gold annotation.

    ``how`` is ``id``, ``text``, ``position`` (equal length required), ``prefix``
    (gold is cut to the number of predictions) or ``auto``. Repeated keys multiply;
    for metrics over a repeated key use ``evaluate_pairs``, which needs no pairs, and for keys
    with very many rows ``align_spread``. Rows with a missing key pair with each other, or, with ``missing="drop"``, are left
    out; tables stored in buckets by the key (``sources.store_bucketed``) are then joined where they lie.
    The positional ways need an order for each side, as a table has none of its own.
    """
    if how == "auto":
        how = choose_key(preds, gold) or "position"
    if how in ("id", "text"):
        return _join(preds, gold, how, missing)
    if how not in ("position", "prefix"):
        raise ValueError(f"cannot align by {how!r}")
    if order_preds is None or order_gold is None:
        raise ValueError("aligning by position needs order_preds and order_gold")
    (left, n_pred), (right, n_gold) = numbered(preds, order_preds), numbered(gold, order_gold)
    if n_pred > n_gold or (how == "position" and n_pred != n_gold):
        raise ValueError(f"{n_pred} predictions and {n_gold} gold rows cannot be paired by {how}")
    if how == "prefix":
        right = right.filter(F.col("pos") <= F.lit(n_pred))
    return _join(left, right, "pos")


def align_counted(
    preds: DataFrame,
    gold: DataFrame,
    key: str = "text",
    pred_columns: Sequence[str] = tuple(f"{d}_pred" for d in DIMENSIONS),
    gold_columns: Sequence[str] = DIMENSIONS,
) -> DataFrame:
    """The rows of ``align`` on a repeated key, equal rows stored once with ``n_rows``.

    Both sides are collapsed to distinct values before they meet, so that copies of
    one sentence cost a count and not a product.
    """
    # What is counted and shuffled is the digest of a text; the text itself comes along once per group.
    left = preds.groupBy(key_of(key).alias("__key"), *pred_columns).agg(F.count("*").alias("__n_pred"), F.any_value(key).alias(key))
    right = gold.groupBy(key_of(key).alias("__key"), *gold_columns).agg(F.count("*").alias("__n_gold"))
    paired = left.withColumnRenamed("__key", "__left").join(
        right.withColumnRenamed("__key", "__right"), F.col("__left").eqNullSafe(F.col("__right"))
    )
    n_rows = (F.col("__n_pred") * F.col("__n_gold")).alias("n_rows")
    return paired.select(key, *pred_columns, *gold_columns, n_rows)


def coverage(preds: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """How many rows were paired, lost or multiplied, from the key counts alone."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = preds.select(key_of(key).alias("key"), one.alias("p"), none.alias("g")).unionByName(
        gold.select(key_of(key).alias("key"), none.alias("p"), one.alias("g"))
    )
    keys = sides.groupBy("key").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    matched = (F.col("p") > 0) & (F.col("g") > 0)
    zero = F.lit(0).cast("long")
    return keys.agg(
        F.coalesce(F.sum("p"), zero).alias("n_pred"),
        F.coalesce(F.sum("g"), zero).alias("n_gold"),
        F.coalesce(F.sum(F.col("p") * F.col("g")), zero).alias("n_aligned"),
        F.coalesce(F.sum(F.when(~matched, F.col("p"))), zero).alias("lost_pred"),
        F.coalesce(F.sum(F.when(~matched, F.col("g"))), zero).alias("lost_gold"),
        F.count_if(matched & ((F.col("p") > 1) | (F.col("g") > 1))).alias("repeated_keys"),
    )


def require_coverage(preds: DataFrame, gold: DataFrame, key: str) -> dict[str, int]:
    """Coverage as numbers; an error if nothing was paired. Check ``complete`` for lost rows."""
    row = coverage(preds, gold, key).first().asDict()
    if row["n_aligned"] == 0:
        raise ValueError("predictions and gold have no row in common")
    row["complete"] = row["n_aligned"] >= row["n_pred"] and row["n_aligned"] >= row["n_gold"]
    return row


def resolve_columns(columns: Sequence[str], dims: Sequence[str] = DIMENSIONS) -> dict[str, tuple[str, str]]:
    """Gold and prediction column of each dimension in an aligned table."""
    found = {}
    for dim in dims:
        if f"{dim}_pred" not in columns:
            raise ValueError(f"prediction column {dim}_pred is missing")
        gold = next((c for c in (dim, f"{dim}_gold") if c in columns), None)
        if gold is None:
            raise ValueError(f"gold column of dimension {dim} is missing")
        found[dim] = (gold, f"{dim}_pred")
    return found
