"""Tables stored for what reads them next: in buckets for joins, and counted while they are written."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS
from tonescale.operators.align import _sides


def store_bucketed(df: DataFrame, table: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """``df`` as a catalog table in hash buckets by ``key``, one file each, sorted by it, below ``path``.

    Tables with the same number of buckets are joined and grouped by the key without a shuffle. Choose so many buckets that
    each fits a task.
    """
    rows = df.repartition(buckets, key)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """The table at ``path`` under its name, for a session whose catalog does not know it yet; it was stored with these buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], partition_by: Sequence[str] = (), keep: Column | None = None) -> dict[str, int]:
    """Write the rows, or those that ``keep`` tells, and return how many fulfil each condition, from the same job.

    The rows are counted in the tasks that write them: a task that is run again counts once.
    """
    seen = Observation()
    watched = df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()])
    kept = watched.filter(keep).select(*[c for c in df.columns if not c.startswith("__")]) if keep is not None else watched
    kept.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return dict(seen.get)


def write_splits_counted(
    long: DataFrame, path: str, dims: Sequence[str] = DIMENSIONS, splits: Sequence[str] = ("train", "val", "test")
) -> list[tuple[str, str, int]]:
    """``write_splits``, and the ``(dim, split, rows)`` of those that have rows, without a job of its own."""
    names = list(product(dims, splits))
    counts = {f"n{i}": (F.col("dim") == d) & (F.col("split") == s) for i, (d, s) in enumerate(names)}
    found = write_counted(long.hint("rebalance", "dim", "split"), path, counts, ("dim", "split"))
    return [(d, s, found[f"n{i}"]) for i, (d, s) in enumerate(names) if found[f"n{i}"]]


def write_aligned(preds: DataFrame, gold: DataFrame, path: str, key: str = "id") -> dict[str, int]:
    """Write the rows of ``align`` by ``key``, and return how many there are and how many rows of each side found no partner.

    An outer join shows the rows that were lost; they are counted where the others are written.
    """
    left, right = _sides(preds, gold, key)
    left, right = left.withColumn("__in_left", F.lit(True)), right.withColumn("__in_right", F.lit(True))
    paired = left.join(right, F.col("__left").eqNullSafe(F.col("__right")), "full_outer")
    both, lost = F.col("__in_left").isNotNull() & F.col("__in_right").isNotNull(), F.col("__in_right").isNull()
    counts = {"n_aligned": both, "lost_pred": lost, "lost_gold": F.col("__in_left").isNull()}
    return write_counted(paired, path, counts, keep=both)
