"""Exact, repeatable train/validation splits and the per-dimension fan-out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS
from tonescale.operators.position import BUCKET_DIGITS, order_digest
from tonescale.session import materialize, scratch

RULES = ("round", "ceil")


# So many digests are ordered on the driver.
_FEW = 10_000
_DIGEST = 32


def train_size(n: int, fraction: float, rule: str) -> int:
    """Rows that go to training.

    ``round``: the training share is rounded half to even. ``ceil``: the
    validation share is rounded up and training gets the rest.
    """
    if rule == "round":
        return round(n * fraction)
    if rule == "ceil":
        return n - math.ceil(n * round(1.0 - fraction, 12))
    raise ValueError(f"rule must be one of {RULES}, not {rule!r}")


@dataclass(frozen=True)
class SplitCut:
    """Where the random order of the keys is cut. Membership is a function of the row key alone."""

    key: str
    seed: int
    n: int
    n_train: int
    last_train_digest: str

    def label(self) -> Column:
        inside = order_digest(self.key, self.seed) <= F.lit(self.last_train_digest)
        return F.when(inside, F.lit("train")).otherwise(F.lit("val"))

    def apply(self, df: DataFrame, name: str = "split") -> DataFrame:
        return df.withColumn(name, self.label())


def _is_plain(df: DataFrame) -> bool:
    """Whether the rows come from one table, row by row, so that reading its key column again costs no more than storing it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    heavy = ("Join", "Aggregate", "Window", "Generate", "Sort", "Repartition", "Python", "Arrow", "Union", "Distinct")
    return plan.collectLeaves().size() == 1 and not any(word in plan.toString() for word in heavy)


def find_cut(
    df: DataFrame, key: str = "id", fraction: float = 0.8, seed: int = 42, rule: str = "round", digits: int = BUCKET_DIGITS, few: int = _FEW
) -> SplitCut:
    """Find the cut that puts exactly the required number of rows into training.

    No row is sorted or shuffled for it. Digests are counted by their leading ``digits`` hex digits, which tells the group
    the cut falls into; that group is counted by the next digits, and so on until it has at most ``few`` rows, whose digests the driver
    orders. Each level is one aggregate of at most 16^``digits`` counts. Keys that come from a join or another costly plan are
    stored once; a plain table's key column is read for each level.
    """
    train_size(0, fraction, rule)
    with scratch(df.sparkSession):
        keys = df.select(key)
        if not _is_plain(keys):
            keys = materialize(keys, "keys")
        return _cut(keys.select(order_digest(key, seed).alias("digest")), key, fraction, seed, rule, digits, few)


def _cut(digests: DataFrame, key: str, fraction: float, seed: int, rule: str, digits: int, few: int) -> SplitCut:
    def counted(prefix: str, length: int) -> list[tuple[str | None, int]]:
        inside = digests.filter(F.col("digest").startswith(prefix)) if prefix else digests
        found = inside.groupBy(F.substring("digest", 1, length).alias("prefix")).agg(F.count("*").alias("size")).collect()
        return sorted(((r["prefix"], r["size"]) for r in found), key=lambda r: (r[0] is not None, r[0]))

    groups = counted("", digits)
    if not groups:
        return SplitCut(key, seed, 0, 0, "")
    if groups[0][0] is None:
        raise ValueError(f"column {key!r} has NULL values and cannot key a split")
    n = sum(size for _, size in groups)
    n_train = train_size(n, fraction, rule)
    if n_train == 0:
        return SplitCut(key, seed, n, 0, "")
    wanted = n_train
    while True:
        # The group that holds row ``wanted`` of those that are left.
        for prefix, size in groups:
            if wanted <= size:
                break
            wanted -= size
        if len(prefix) == _DIGEST:
            if wanted != size:
                raise ValueError(f"column {key!r} is not unique: {size} rows share the key at the cut")
            return SplitCut(key, seed, n, n_train, prefix)
        groups = counted(prefix, _DIGEST if size <= few else min(_DIGEST, len(prefix) + digits))


def split_exact(
    df: DataFrame, key: str = "id", fraction: float = 0.8, seed: int = 42, rule: str = "round"
) -> DataFrame:
    """Add a ``split`` column with exactly the required number of training rows."""
    return find_cut(df, key, fraction, seed, rule).apply(df)


def complement(df: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``df`` that were not chosen, for a sample that came from elsewhere.

    For a split of our own, filter on ``split`` instead: that needs no join.
    """
    return df.join(chosen.select(key), key, "left_anti")


def to_long(
    df: DataFrame,
    dims: Sequence[str] = DIMENSIONS,
    keep: Sequence[str] = ("id", "text"),
    variable: str = "dim",
    value: str = "value",
) -> DataFrame:
    """One row per dimension; every dimension sees the same rows and the same split."""
    return df.unpivot(list(keep), list(dims), variable, value)


def split_sizes(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
