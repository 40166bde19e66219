"""Row positions, batches and random order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonescale.session import materialize

# Rows are numbered inside a partition in the low 33 bits of monotonically_increasing_id().
_ROW_BITS = 33
# Hash buckets are named by this many leading hex digits: at most 65,536 of them.
BUCKET_DIGITS = 4


def _has_map(kind: T.DataType) -> bool:
    """Spark hashes no maps."""
    return "map<" in kind.simpleString()


def numbered(df: DataFrame, order_by: Sequence[Column | str], name: str = "pos") -> tuple[DataFrame, int]:
    """``with_position`` together with the number of rows."""
    row = "__row"
    # Rows that are equal in the order are spread, and ordered, by a hash of all their columns.
    order = [*order_by, F.xxhash64(*[f.name for f in df.schema if not _has_map(f.dataType)])]
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()),
        "position",
    )
    part = F.shiftrightunsigned(row, _ROW_BITS)
    # One count per shuffle partition.
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()
    offsets, total = [], 0
    for size in sorted(sizes):
        offsets.append((size["part"], total))
        total += size["size"]
    before = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    inside = F.col(row).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    positions = (
        placed.withColumn("__part", part)
        .join(F.broadcast(before), "__part")
        .withColumn(name, inside + F.col("__offset") + F.lit(1))
        .drop("__part", "__offset", row)
    )
    return positions, total


def with_position(df: DataFrame, order_by: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """Number the rows 1..n in the given order.

    The rows are range-partitioned and sorted once, numbered inside their
    partition, and written to the scratch folder, so that the partition sizes and
    the rows they belong to cannot drift apart if executors are lost. The offset of
    each partition is then added by a join whose broadcast side has one row per
    shuffle partition. Pass only the columns needed afterwards. Rows that are equal in the order follow each other by a hash
    of all their columns, so the positions are repeatable and a frequent order key is spread over tasks; only copies that
    are equal in every column stay together.
    """
    return numbered(df, order_by, name)[0]


def order_digest(key: str, seed: int, epoch: int | None = None) -> Column:
    """Sort key of a repeatable random order: the MD5 of seed, epoch and row key."""
    prefix = f"{seed}-" if epoch is None else f"{seed}-{epoch}-"
    return F.md5(F.concat(F.lit(prefix), F.col(key).cast("string")))


def shuffled_position(df: DataFrame, key: str, seed: int, epoch: int, name: str = "pos") -> DataFrame:
    """Number the rows 1..n in the random order of one epoch. ``key`` must be unique.

    Digests are uniform, so their leading digits cut the rows into even buckets
    whatever the keys look like: each is sorted on its own and shifted by the
    number of rows in the buckets before it (at most 65,536 counts, broadcast).
    The plan is a pure function of the rows and needs no stored intermediate.
    """
    keyed = df.withColumn("__digest", order_digest(key, seed, epoch)).withColumn(
        "__bucket", F.substring("__digest", 1, BUCKET_DIGITS)
    )
    bucket = F.substring(order_digest(key, seed, epoch), 1, BUCKET_DIGITS).alias("__bucket")
    sizes = df.select(bucket).groupBy("__bucket").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__digest", key))
    return (
        keyed.withColumn(name, inside.cast("long"))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(name, F.col(name) + F.col("__offset"))
        .drop("__bucket", "__offset", "__digest")
    )


def batch_of(position: Column | str, batch_size: int = 16) -> Column:
    """Zero-based batch of a one-based position."""
    pos = F.col(position) if isinstance(position, str) else position
    return F.floor((pos - F.lit(1)) / F.lit(float(batch_size))).cast("long")
