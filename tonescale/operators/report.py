"""Metric reports: rendering, parsing, and tables that compare runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS, dimension_name, fixed4, is_present, number_after_equals, rest_after_equals, to_number

# The labels of the two metric lines of a report.
MAE_LABEL = "MAE"
PEARSON_LABEL = "Pearson"
PEARSON_LINE = "Pearson’s r"
METRICS = ("mae", "pearson_r")


def _dim_order(dim: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), dim)


def render_report(metrics: DataFrame, by: str = "run", title: str = "Evaluation") -> DataFrame:
    """``(by, value)``: the text of one report per run, four decimals, dimensions in fixed order."""
    section = F.concat(
        F.col("dim"), F.lit(f":\n  {MAE_LABEL} = "), fixed4("mae"),
        F.lit(f"\n  {PEARSON_LINE} = "), fixed4("pearson_r"), F.lit("\n\n"),
    )
    body = F.array_sort(F.collect_list(F.struct(_dim_order(F.col("dim")).alias("at"), section.alias("text"))))
    reports = metrics.groupBy(by).agg(body.alias("sections"))
    heading = F.concat(F.lit(f"{title} - "), F.col(by).cast("string"))
    text = F.concat(
        heading, F.lit("\n"), F.repeat(F.lit("="), F.length(heading)), F.lit("\n\n"),
        F.concat_ws("", F.transform("sections", lambda s: s["text"])),
    )
    return reports.select(by, text.alias("value"))


def report_lines(reports: DataFrame, by: str = "run") -> DataFrame:
    """``(by, line_no, line)``, lines trimmed."""
    return reports.select(by, F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).select(
        by, "line_no", F.trim("line").alias("line")
    )


def carry_section(lines: DataFrame, by: str = "run") -> DataFrame:
    """Carry the dimension of the last section heading down to the lines below it.

    A report comes out of one row, so the lines of one ``by`` fit in a task.
    """
    ordered = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("line").isin(*[f"{d}:" for d in DIMENSIONS])
    return (
        lines.withColumn("__opens", opens)
        .withColumn("dim", F.last(F.when(F.col("__opens"), F.rtrim("line", F.lit(":"))), ignorenulls=True).over(ordered))
        .withColumn("section_no", F.sum(F.when(F.col("__opens"), 1).otherwise(0)).over(ordered).cast("int"))
        .drop("__opens")
    )


def _readings() -> tuple[Column, Column]:
    line = F.col("line")
    mae = F.when(line.contains(MAE_LABEL), number_after_equals(line, MAE_LABEL))
    pearson = F.when(line.contains(PEARSON_LABEL), number_after_equals(line))
    return mae, pearson


def parse_sections(lines: DataFrame, by: str = "run") -> DataFrame:
    """Reports with a section per dimension: ``(by, section_no, dim, mae, pearson_r)``.

    The last readable line of each metric counts; a section without one gives NULL.
    """
    mae, pearson = _readings()
    inside = carry_section(lines, by).filter(F.col("dim").isNotNull())
    read = inside.withColumn("__mae", mae).withColumn("__r", pearson)
    return read.groupBy(by, "section_no", "dim").agg(
        F.max_by("__mae", F.when(F.col("__mae").isNotNull(), F.col("line_no"))).alias("mae"),
        F.max_by("__r", F.when(F.col("__r").isNotNull(), F.col("line_no"))).alias("pearson_r"),
    )


def parse_single(lines: DataFrame, by: str = "run", keep: str = "first") -> DataFrame:
    """Reports on one dimension each: ``(by, mae, pearson_r)``.

    ``first``: the first line that names a metric counts, and all behind its ``=`` has to be a number (else
    NULL). ``last``: the last readable one counts, whatever follows the number.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    mae, pearson = _readings()
    if keep == "first":
        mae = pearson = rest_after_equals(F.col("line"))
    read = lines.withColumn("__mae", mae).withColumn("__r", pearson)
    picked = []
    for name, value, label in (("mae", "__mae", MAE_LABEL), ("pearson_r", "__r", PEARSON_LABEL)):
        if keep == "first":
            at = F.when(F.col("line").contains(label), F.col("line_no"))
            picked.append(F.min_by(value, at).alias(name))
        else:
            at = F.when(F.col(value).isNotNull(), F.col("line_no"))
            picked.append(F.max_by(value, at).alias(name))
    return read.groupBy(by).agg(*picked)


def table_single(parsed: DataFrame, dim: str = "dim", by: Sequence[str] = ()) -> DataFrame:
    """One row per report that has both metrics."""
    return parsed.dropna(how="any", subset=list(METRICS)).select(
        *by, F.coalesce(dimension_name(dim), F.col(dim)).alias("dimension"), *METRICS
    )


def table_sections(parsed: DataFrame, by: str = "run") -> DataFrame:
    """One row per section with an MAE; the correlation may be missing."""
    return parsed.filter(F.col("mae").isNotNull()).select(
        by, "section_no", dimension_name("dim").alias("dimension"), *METRICS
    )


def last_sections(parsed: DataFrame, by: str = "run") -> DataFrame:
    """Where a report repeats a dimension, its last section."""
    latest = F.struct("section_no", *METRICS)
    return (
        parsed.groupBy(by, "dim")
        .agg(F.max_by(latest, "section_no").alias("s"))
        .select(by, "dim", *[F.col("s").getField(m).alias(m) for m in METRICS])
    )


def compare_runs(a: DataFrame, b: DataFrame, by: Sequence[str] = (), names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both runs side by side on the fixed dimensions; what is missing is NULL.

    ``a`` and ``b`` have ``dim, mae, pearson_r`` and the columns ``by``. All
    metrics of one group come together in one aggregate, so neither side is broadcast.
    """
    sides = [
        df.select(*by, "dim", *METRICS, F.lit(name).alias("__side")) for df, name in zip((a, b), names, strict=True)
    ]
    both = sides[0].unionByName(sides[1])
    cells = both.groupBy(*by).agg(
        *[
            F.max(F.when((F.col("__side") == name) & (F.col("dim") == dim), F.col(m))).alias(f"{name}_{dim}_{m}")
            for name in names
            for dim in DIMENSIONS
            for m in METRICS
        ]
    )
    rows = [
        F.struct(
            F.lit(dim).alias("dim"),
            *[F.col(f"{name}_{dim}_{m}").alias(f"{m}_{name}") for name in names for m in METRICS],
        )
        for dim in DIMENSIONS
    ]
    return cells.select(*by, F.inline(F.array(*rows))).withColumn("dimension", dimension_name("dim")).drop("dim")


def chart_long(compared: DataFrame, by: Sequence[str] = (), names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``(dimension, run, metric, value)`` for charts: lenient numbers, rows without any value removed."""
    columns = [f"{m}_{name}" for name in names for m in METRICS]
    numeric = compared.withColumns({c: to_number(c) for c in columns}).dropna(how="all", subset=columns)
    cells = [
        F.struct(F.lit(name).alias("run"), F.lit(m).alias("metric"), F.col(f"{m}_{name}").alias("value"))
        for name in names
        for m in METRICS
    ]
    return numeric.select(*by, "dimension", F.inline(F.array(*cells))).filter(is_present("value"))


def learning_curve(train: DataFrame, val: DataFrame | None = None, by: Sequence[str] = ("run",)) -> DataFrame:
    """``(by, epoch, train_loss, val_loss)``; without a validation log only the training losses."""
    left = train.select(*by, "epoch", F.col("loss").alias("train_loss"))
    if val is None:
        return left.withColumn("val_loss", F.lit(None).cast("double"))
    return left.join(val.select(*by, "epoch", F.col("loss").alias("val_loss")), [*by, "epoch"], "left")
