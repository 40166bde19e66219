"""Mean absolute error, guarded correlation and batch-averaged losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonescale.functions import DIMENSIONS, SCALE, is_present, is_scaled, smooth_l1
from tonescale.operators.align import key_of, resolve_columns

# Relative and absolute tolerance within which a column counts as constant.
RTOL, ATOL = 1e-5, 1e-8


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def _ratio(cov: Column, spread: Column) -> Column:
    # Rounding may push a perfect correlation past one.
    return F.least(F.greatest(F.try_divide(cov, spread), F.lit(-1.0)), F.lit(1.0))


def pearson(y: Column, p: Column) -> Column:
    """Pearson's r; NULL where a side is constant.

    ``corr`` would fail there under ANSI rules, and the deviation of a constant column
    need not be exactly zero once partial results are merged: its bounds tell.
    """
    varies = (F.max(y) > F.min(y)) & (F.max(p) > F.min(p))
    return F.when(varies, _ratio(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p)))


def _all_close(low: Column, high: Column, first: Column) -> Column:
    """Every value lies within tolerance of ``first``."""
    return F.greatest(high - first, first - low) <= F.lit(ATOL) + F.abs(first) * F.lit(RTOL)


def guarded_pearson(y: Column, p: Column, order: Column | None = None, factor: Column | None = None) -> Column:
    """Pearson's r, or 0 where it is undefined: a side (nearly) constant, or fewer than two rows.

    A side is constant if all of it is close to its value in the first row by
    ``order`` (the smallest value, without an order). ``factor`` scales ``p`` for that test.
    """

    def constant(v: Column, k: Column) -> Column:
        first = F.min(v) if order is None else F.min_by(v, F.when(v.isNotNull(), order))
        return _all_close(F.min(v) * k, F.max(v) * k, first * k)

    one = F.lit(1.0)
    flat = constant(y, one) | constant(p, one if factor is None else factor)
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(pearson(y, p), F.lit(0.0)))


def _fixed_width(df: DataFrame, order: str) -> Column:
    """An order that a hash aggregate can keep in place: of a text its number, or where it is none its hash."""
    c = F.col(order)
    if isinstance(df.schema[order].dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(c.try_cast("long"), F.xxhash64(c))
    return c


def evaluate(
    aligned: DataFrame,
    dims: Sequence[str] = DIMENSIONS,
    by: Sequence[str] = (),
    order: str | None = "id",
    auto_unscale: bool = False,
    on_constant: str = "zero",
) -> DataFrame:
    """MAE and Pearson's r of every dimension, per group of ``by``.

    One aggregate computes all dimensions side by side and is turned into rows
    afterwards: the data is neither tripled nor sorted, and each task sends one row
    per group. Rows with a missing side are counted in ``n_missing`` and left out.
    With ``auto_unscale`` the errors on both scales are kept and the maximum, known
    at the end of the same pass, decides between them.
    """
    if on_constant not in ("zero", "null"):
        raise ValueError("on_constant is 'zero' or 'null'")
    first_by = _fixed_width(aligned, order) if order and order in aligned.columns else None
    inputs, records, measures = [], [], []
    for dim, (gold, pred) in resolve_columns(aligned.columns, dims).items():
        y, p = F.col(gold).cast("double"), F.col(pred).cast("double")
        complete = is_present(y) & is_present(p)
        inputs += [
            F.when(complete, y).alias(f"__y_{dim}"),
            F.when(complete, p).alias(f"__p_{dim}"),
            p.alias(f"__all_{dim}"),
        ]
        y, p = F.col(f"__y_{dim}"), F.col(f"__p_{dim}")
        error, factor = mae(y, p), None
        if auto_unscale:
            scaled = is_scaled(F.max(F.nanvl(F.col(f"__all_{dim}"), F.lit(None).cast("double"))))
            error = F.when(scaled, mae(y, p * F.lit(SCALE))).otherwise(error)
            factor = F.when(scaled, F.lit(SCALE)).otherwise(F.lit(1.0))
        r = pearson(y, p) if on_constant == "null" else guarded_pearson(y, p, None if first_by is None else F.col("__first"), factor)
        measures += [
            F.count(y).alias(f"n_{dim}"),
            (F.count("*") - F.count(y)).alias(f"n_missing_{dim}"),
            error.alias(f"mae_{dim}"),
            r.alias(f"pearson_r_{dim}"),
        ]
        records.append(
            F.struct(
                F.lit(dim).alias("dim"),
                *[F.col(f"{name}_{dim}").alias(name) for name in ("n", "n_missing", "mae", "pearson_r")],
            )
        )
    kept = [*by, first_by.alias("__first")] if first_by is not None else list(by)
    wide = aligned.select(*kept, *inputs).groupBy(*by).agg(*measures)
    return wide.select(*by, F.inline(F.array(*records)))


def _distinct_values(preds: DataFrame, gold: DataFrame, key: str, dims: Sequence[str], origin: float) -> DataFrame:
    """Per (key, dimension, value): how many predictions and gold rows have it."""

    def side(df: DataFrame, columns: dict[str, str], is_pred: int) -> DataFrame:
        values = [F.col(c).cast("double").alias(d) for d, c in columns.items()]
        long = df.select(key_of(key).alias("key"), *values).unpivot(["key"], list(columns), "dim", "v")
        return long.select(
            "key",
            "dim",
            F.when(is_present("v"), F.col("v") - F.lit(origin)).alias("v"),
            F.lit(is_pred).alias("p"),
            F.lit(1 - is_pred).alias("y"),
        )

    sides = side(preds, {d: f"{d}_pred" for d in dims}, 1).unionByName(side(gold, {d: d for d in dims}, 0))
    return sides.groupBy("key", "dim", "v").agg(F.sum("p").cast("double").alias("p"), F.sum("y").cast("double").alias("y"))


def evaluate_pairs(
    preds: DataFrame,
    gold: DataFrame,
    key: str = "text",
    dims: Sequence[str] = DIMENSIONS,
    origin: float = 3.0,
    resolution: float = 64.0,
) -> DataFrame:
    """``evaluate`` over all pairs that share a repeated key, without forming a pair.

    A key with m predictions and n gold rows stands for m*n pairs. Their sums and
    products factor into sums per side. Their absolute differences come from running
    totals over the sorted values: within narrow value bands first, then across the
    bands, so that the work on one key, however common, is spread over the bands.
    Equal values are merged into counts beforehand. ``origin`` is a value near the
    middle of the scale, ``resolution`` the number of bands per unit.
    """
    resolve_columns([*gold.columns, *[c for c in preds.columns if c.endswith("_pred")]], dims)
    values = _distinct_values(preds, gold, key, dims, origin)
    known = F.col("v").isNotNull()
    points = values.select(
        "key",
        "dim",
        "v",
        F.floor(F.col("v") * F.lit(resolution)).alias("band"),
        F.when(known, F.col("p")).otherwise(F.lit(0.0)).alias("p"),
        F.when(known, F.col("y")).otherwise(F.lit(0.0)).alias("y"),
        F.when(known, F.lit(0.0)).otherwise(F.col("p")).alias("p_missing"),
        F.when(known, F.lit(0.0)).otherwise(F.col("y")).alias("y_missing"),
        F.coalesce(F.col("v"), F.lit(0.0)).alias("x"),
    )

    def earlier(total: Column, window) -> Column:
        return F.coalesce(F.sum(total).over(window), F.lit(0.0))

    in_band = Window.partitionBy("key", "dim", "band").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    p, y, x = F.col("p"), F.col("y"), F.col("x")
    within = p * (x * earlier(y, in_band) - earlier(y * x, in_band)) + y * (
        x * earlier(p, in_band) - earlier(p * x, in_band)
    )
    bands = (
        points.withColumn("apart", within)
        .groupBy("key", "dim", "band")
        .agg(
            F.sum("p").alias("p"),
            F.sum("y").alias("y"),
            F.sum(p * x).alias("px"),
            F.sum(y * x).alias("yx"),
            F.sum(p * x * x).alias("pxx"),
            F.sum(y * x * x).alias("yxx"),
            F.sum("p_missing").alias("p_missing"),
            F.sum("y_missing").alias("y_missing"),
            F.sum("apart").alias("apart"),
            F.min(F.when(p > 0, x)).alias("p_low"),
            F.max(F.when(p > 0, x)).alias("p_high"),
            F.min(F.when(y > 0, x)).alias("y_low"),
            F.max(F.when(y > 0, x)).alias("y_high"),
        )
    )
    below = Window.partitionBy("key", "dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    px, yx = F.col("px"), F.col("yx")
    across = px * earlier(y, below) - p * earlier(yx, below) + yx * earlier(p, below) - y * earlier(px, below)
    summed = ["p", "y", "px", "yx", "pxx", "yxx", "p_missing", "y_missing", "apart"]
    keys = (
        bands.withColumn("apart", F.col("apart") + across)
        .groupBy("key", "dim")
        .agg(
            *[F.sum(c).alias(c) for c in summed],
            *[F.min(c).alias(c) for c in ("p_low", "y_low")],
            *[F.max(c).alias(c) for c in ("p_high", "y_high")],
        )
    )
    paired = (F.col("p") > 0) & (F.col("y") > 0)
    totals = keys.groupBy("dim").agg(
        F.sum(p * y).alias("w"),
        F.sum((p + F.col("p_missing")) * (y + F.col("y_missing"))).alias("w_all"),
        F.sum(F.when(paired, F.col("apart"))).alias("apart"),
        F.sum(px * y).alias("sp"),
        F.sum(yx * p).alias("sy"),
        F.sum(F.col("pxx") * y).alias("spp"),
        F.sum(F.col("yxx") * p).alias("syy"),
        F.sum(px * yx).alias("spy"),
        *[F.min(F.when(paired, F.col(c))).alias(c) for c in ("p_low", "y_low")],
        *[F.max(F.when(paired, F.col(c))).alias(c) for c in ("p_high", "y_high")],
    ).filter("w_all > 0")
    w = F.col("w")
    mean_p, mean_y = F.try_divide("sp", w), F.try_divide("sy", w)
    var_p = F.greatest(F.try_divide("spp", w) - mean_p * mean_p, F.lit(0.0))
    var_y = F.greatest(F.try_divide("syy", w) - mean_y * mean_y, F.lit(0.0))
    flat = F.lit(False)
    for side in ("p", "y"):
        low, high = F.col(f"{side}_low") + F.lit(origin), F.col(f"{side}_high") + F.lit(origin)
        flat = flat | _all_close(low, high, low)
    r = _ratio(F.try_divide("spy", w) - mean_p * mean_y, F.sqrt(var_p) * F.sqrt(var_y))
    return totals.select(
        "dim",
        w.cast("long").alias("n"),
        (F.col("w_all") - w).cast("long").alias("n_missing"),
        F.try_divide("apart", w).alias("mae"),
        F.when(flat, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0))).alias("pearson_r"),
    )


def row_loss(pairs: Sequence[tuple[str, str]]) -> Column:
    """Smooth-L1 loss of one row: the mean over its (gold, prediction) column pairs."""
    losses = [smooth_l1(F.col(p).cast("double") - F.col(y).cast("double")) for y, p in pairs]
    total = losses[0]
    for loss in losses[1:]:
        total = total + loss
    return total / F.lit(float(len(losses)))


def batch_losses(df: DataFrame, pairs: Sequence[tuple[str, str]], batch: str = "batch_id", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, batch).agg(F.count("*").alias("n"), F.avg(row_loss(pairs)).alias("batch_loss"))


def epoch_loss(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain mean of the batch means: a short last batch counts in full."""
    return batches.groupBy(*by).agg(F.count("*").alias("n_batches"), F.avg("batch_loss").alias("loss"))


def any_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row that tells of each numeric column whether it has any value."""
    return df.agg(*[F.coalesce(F.bool_or(is_present(F.col(c))), F.lit(False)).alias(c) for c in columns])
