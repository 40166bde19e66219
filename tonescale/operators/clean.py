"""Checks, missing values, casts and rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS, SCALE, is_scaled, scale_target, unscale_prediction


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing column(s) {absent}; the table has {df.columns}")
    return df


def has_labels(df: DataFrame, targets: Sequence[str] = DIMENSIONS) -> bool:
    """All targets are there; with only some of them a table counts as unlabelled."""
    return set(targets) <= set(df.columns)


def drop_missing(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows where any (or all) of the columns are NULL or NaN."""
    return df.dropna(how=how, subset=list(columns))


def cast_targets(df: DataFrame, targets: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Targets as doubles; text that is no number fails the job (ANSI cast)."""
    return df.withColumns({t: F.col(t).cast("double") for t in targets})


def clean_annotated(df: DataFrame, targets: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Complete rows of an annotated table, or rows with text where there are no labels."""
    require_columns(df, "text")
    if has_labels(df, targets):
        return cast_targets(drop_missing(df, ["text", *targets]), targets)
    return drop_missing(df, ["text"])


def select_target(df: DataFrame, target: str, key: str = "id") -> DataFrame:
    return df.select(key, "text", target)


def scale_targets(df: DataFrame, targets: Sequence[str] = DIMENSIONS, suffix: str = "") -> DataFrame:
    return df.withColumns({f"{t}{suffix}": scale_target(t) for t in targets})


def unscale_predictions(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": unscale_prediction(c) for c in columns})


def auto_unscale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring each prediction column back to the annotation scale if all of it is at most one.

    The maxima are one row, found by a scan of these columns alone and used as a
    scalar subquery: the rows themselves are not moved. Off by default in
    ``evaluate``, since true predictions may all be at most one as well.
    """
    none = F.lit(None).cast("double")
    peaks = df.agg(F.struct(*[F.max(F.nanvl(F.col(c).cast("double"), none)).alias(c) for c in columns]).alias("peaks"))
    found = peaks.scalar()
    return df.withColumns(
        {c: F.when(is_scaled(found.getField(c)), F.col(c) * F.lit(SCALE)).otherwise(F.col(c)) for c in columns}
    )


def head_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    return df.orderBy(key).limit(n)
