"""Text reports: one file is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_of(file: Column) -> Column:
    """The partition folder ``run=...`` a file lies in, else the name of the file."""
    folder = F.regexp_extract(file, "/run=([^/]*)/", 1)
    return F.url_decode(F.when(folder != "", folder).otherwise(F.regexp_extract(file, "[^/]*$", 0)))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``(run, value)``; the run is the partition folder a report lies in, else its file name."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return found.select(run_of(F.col("_metadata.file_path")).alias("run"), "value")


def write_reports(reports: DataFrame, path: str, by: str = "run") -> None:
    """One text file per run, from a table ``(by, value)``."""
    reports.select("value", F.col(by).alias("run")).write.mode("overwrite").partitionBy("run").option(
        "lineSep", "\n"
    ).text(path)
