"""What a table or a folder of CSV files looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonescale.functions import missing_to_null, to_number
from tonescale.sources.tables import csv_rows

_NUMERIC = (T.NumericType, T.BooleanType)


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """One row: columns, rows, and whether the first column besides ``text`` is numeric."""
    targets = [f for f in df.schema.fields if f.name != "text"]
    target = targets[0] if targets else None
    return df.agg(
        F.lit(name).alias("name"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count("*").alias("n_rows"),
        F.lit("text" in df.columns).alias("has_text"),
        F.lit(len(df.columns) == 2).alias("two_columns"),
        F.lit(target.name if target else None).cast("string").alias("target"),
        F.lit(isinstance(target.dataType, _NUMERIC) if target else None).cast("boolean").alias("target_numeric"),
    )


def _no_number(c: Column) -> Column:
    """A value that keeps its column from being numeric: neither missing nor a number."""
    return missing_to_null(c).isNotNull() & to_number(c).isNull()


def _no_boolean(c: Column) -> Column:
    """A column of truth values counts as numeric, but only if all of it is of that kind."""
    return ~F.coalesce(c.isin("True", "False", "TRUE", "FALSE", "true", "false"), F.lit(False))


def profile_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per CSV file of a folder, whatever its width.

    Files may have different headers, so all are read by position. A file that cannot be profiled gets
    an ``error`` and does not stop the others: empty, or more fields in a row than
    header names.
    """
    rows, headers = csv_rows(spark, path)
    text_first = F.get("names", F.lit(0)) == F.lit("text")
    at = F.when(text_first, F.lit(1)).otherwise(F.lit(0))
    value = F.get("fields", at)
    # One row for each file, which the driver has listed anyway.
    body = rows.join(F.broadcast(headers), "__file")
    counts = (
        body.select("__file", "width", _no_number(value).alias("text"), _no_boolean(value).alias("other"))
        .groupBy("__file")
        .agg(F.count("*").alias("n"), F.max("width").alias("width"), F.count_if("text").alias("text"), F.count_if("other").alias("other"))
    )
    counts = headers.select("__file", F.col("names").alias("named"), F.size("names").alias("n_columns")).join(counts, "__file", "left")
    counts = counts.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    named = F.col("named")
    target = F.get(named, F.when(F.get(named, F.lit(0)) == F.lit("text"), F.lit(1)).otherwise(F.lit(0)))
    # A column without any row has no type.
    numeric = (F.col("n") > 0) & ((F.col("text") == 0) | (F.col("other") == 0))
    error = F.when(F.col("n").isNull(), F.lit("no columns")).when(F.col("width") > F.col("n_columns"), F.lit("more fields than header names"))
    # The file listing, which the driver holds anyway, also has the files without a byte.
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).inputFiles()
    listed = spark.createDataFrame([(f,) for f in found], "listed string").withColumn("listed", F.url_decode("listed"))

    def plain(c: str) -> Column:
        # Local paths are listed with one or with three slashes.
        return F.regexp_replace(c, "^file:/+", "/")

    decoded = counts.withColumn("file", F.url_decode("__file"))
    joined = listed.join(decoded, plain("listed") == plain("file"), "left")
    ok = error.isNull()
    return joined.select(
        F.regexp_extract("listed", "[^/]*$", 0).alias("name"),
        F.when(ok, F.array_join(named, ",")).alias("columns"),
        F.when(ok, F.col("n_columns")).alias("n_columns"),
        F.when(ok, F.col("n")).alias("n_rows"),
        F.when(ok, F.array_contains(named, F.lit("text"))).alias("has_text"),
        F.when(ok, F.col("n_columns") == 2).alias("two_columns"),
        F.when(ok, target).alias("target"),
        F.when(ok & target.isNotNull(), numeric).alias("target_numeric"),
        error.alias("error"),
    )
