"""Annotated and unlabelled tables, split tables and predictions."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS, missing_to_null
from tonescale.operators.clean import require_columns
from tonescale.operators.position import with_position
from tonescale.session import materialize


_FILE, _ROW = "__file", "__row"


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the lines ``(file, start, value)`` of files, in their order: the header of each, with its fields as names."""
    file, lines = None, None

    def header() -> Iterator[pa.RecordBatch]:
        if lines:
            names = [n or None for n in next(csv.reader(io.StringIO("\n".join(lines), newline="")))]
            yield pa.record_batch([pa.array([file]), pa.array([names], pa.list_(pa.string()))], [_FILE, "names"])

    for batch in batches:
        for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != file:
                yield from header()
                file, lines, open_quotes = at, [], True
            # The header may go on behind a line break in quotes.
            if open_quotes and (lines or value):
                lines.append(value)
                open_quotes = sum(line.count('"') for line in lines) % 2 == 1
    yield from header()


def csv_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, headers)`` of a CSV file or a folder of them, read by position, in two passes over the files.

    ``headers`` has the ``names`` of each ``__file``, stored: the task that reads a file's first split sees its header. ``rows``
    has ``__file``, ``__row`` (ascending within a file), ``fields`` and ``width``, the number of fields up to the last one in use,
    without the headers. Quoted commas, quotes and line breaks are kept. There are as many fields as in the widest header, and one
    more: what exceeds that shows in ``width``. Nothing depends on how the files are dealt to tasks.
    """

    def reader():
        return spark.read.option("pathGlobFilter", "*.csv") if not path.endswith(".csv") else spark.read

    starts = reader().text(path).filter(F.col("_metadata.file_block_start") == 0)
    lines = starts.select(F.col("_metadata.file_path").alias(_FILE), "value")
    headers = materialize(lines.mapInArrow(_first_records, f"{_FILE} string, names array<string>"), "headers")
    widest = headers.agg(F.max(F.size("names"))).first()[0] or 0
    columns = [f"c{i}" for i in range(widest + 1)]
    raw = reader().schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("multiLine", True)
    found = raw.option("escape", '"').option("encoding", "UTF-8").csv(path)
    used = F.array_max(F.array(F.lit(0), *[F.when(F.col(c).isNotNull(), F.lit(i + 1)) for i, c in enumerate(columns)]))
    rows = found.select(
        F.col("_metadata.file_path").alias(_FILE), F.monotonically_increasing_id().alias(_ROW), F.array(*columns).alias("fields"), used.alias("width")
    )
    # Trailing commas of a header name nothing.
    named = F.array_max(F.transform("names", lambda n, i: F.when(n.isNotNull(), i + 1).otherwise(F.lit(0))))
    return rows, headers.select(_FILE, F.slice("names", 1, F.coalesce(named, F.lit(0))).alias("names"))


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by the names in each file's own header, and the place of each row; missing tokens as NULL."""
    rows, headers = csv_rows(spark, path)
    # As many rows as there are different headers.
    layouts = headers.select("names").distinct().collect()
    names = list(dict.fromkeys(n for r in layouts for n in r["names"] if n))
    if not layouts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("text", _FILE))).withColumn(_ROW, F.lit(0).cast("long"))
    if len(layouts) == 1:
        placed = rows.withColumn("names", F.array(*[F.lit(n).cast("string") for n in layouts[0]["names"]]))
    else:
        # One row for each file, which the driver has listed anyway.
        placed = rows.join(F.broadcast(headers), _FILE)
    # A name that a header lacks has position 0, and so no field.
    fields = [missing_to_null(F.when(F.array_position("names", n) > 0, F.get("fields", F.array_position("names", n).cast("int") - 1))).alias(n) for n in names]
    return placed.select(*fields, _FILE, _ROW)


def _with_id(df: DataFrame) -> DataFrame:
    """Numeric ids as numbers; without ids, rows are numbered in the order of files and rows. The rows are stored, so the files are not read again."""
    if "id" not in df.columns:
        return with_position(df, [_FILE, _ROW], "id").drop(_FILE, _ROW)
    df = materialize(df.drop(_FILE, _ROW), "csv")
    named = F.col("id").isNotNull() & F.col("id").try_cast("long").isNull()
    numeric = not df.filter(named).limit(1).count()
    return df.withColumn("id", F.col("id").cast("long")) if numeric else df


def read_annotated(spark: SparkSession, path: str, targets: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``text``, ``id``, the targets that are there as doubles, and any other column as text.

    Each file's own header says which column is which, so files of a folder may differ in it; a column that a file
    lacks is NULL there. Ids that are all numbers are numbers; a table without ids gets them, 1..n in the order of files and rows.
    Types are not inferred otherwise. A target that is no number fails the job. A file with line breaks inside quotes is read by one
    task: for large inputs use ``import_annotated`` once, and many files.
    """
    df = _with_id(require_columns(_read_csv(spark, path), "text"))
    return df.withColumns({t: F.col(t).cast("double") for t in targets if t in df.columns})


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and ``text``; ids as in ``read_annotated``."""
    df = require_columns(_read_csv(spark, path), "text")
    return _with_id(df.select(*[c for c in ("id", "text") if c in df.columns], _FILE, _ROW)).select("id", "text")


def import_annotated(spark: SparkSession, path: str, out: str, targets: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Convert CSV to parquet once; later jobs then split the files and prune columns."""
    read_annotated(spark, path, targets).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV that ``read_annotated`` reads back, but for texts that are a missing token, such as ``NA`` or the empty one: these become NULL."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_splits(long: DataFrame, path: str, by: Sequence[str] = ("dim", "split"), mode: str = "overwrite") -> None:
    """One folder per dimension and split. Rows are dealt out by folder first, in even parts, so that each has few files."""
    long.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_predictions(df: DataFrame, path: str, run: str, eval_set: str, fmt: str = "parquet") -> str:
    """Predictions under ``run=.../eval_set=...``, so that two evaluation sets of a run never overwrite each other."""
    target = f"{path.rstrip('/')}/run={run}/eval_set={eval_set}"
    if fmt == "csv":
        write_csv(df, target)
    else:
        df.write.mode("overwrite").format(fmt).save(target)
    return target
