"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Shuffle partitions to start from: one for this many input bytes, but not fewer than the least.
_BYTES_PER_PARTITION = 256 << 20
_LEAST_PARTITIONS = 200


def build_session(
    app_name: str = "tonescale", master: str | None = None, input_bytes: int = 0, max_partitions: int = 50_000, **conf: str
) -> SparkSession:
    """Session with the settings the jobs are written for; keyword settings win.

    Adaptive execution joins small shuffle partitions but does not cut large ones, so
    a shuffle starts from a number that fits ``input_bytes``, the size of the data,
    up to ``max_partitions``.
    """
    partitions = min(max(_LEAST_PARTITIONS, input_bytes // _BYTES_PER_PARTITION), max_partitions)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder of its own, one for each application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="tonescale-")
    return _local_roots[application]


# The folders of local applications without a shared one.
_local_roots: dict[str, str] = {}
# The scratch tables of each application of this process.
_made: dict[str, list[str]] = {}
# The names of those that are bucketed.
_tables: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder."""
    path = f"{scratch_root(spark).rstrip('/')}/tonescale-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside it at its end, also after an error: for jobs whose result does not read them."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        _remove(spark, made, before)


def _remove(spark: SparkSession, made: list[str], keep: int = 0) -> int:
    removed = 0
    while len(made) > keep:
        name = made.pop()
        if name in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(name)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = (), options: Mapping[str, int | bool] | None = None) -> DataFrame:
    """Write ``df`` to a new scratch table, with these ``options`` of its files, and read it back.

    Later jobs over the result do not depend on the executors that computed it,
    and read only the columns and partitions they need. ``clear_scratch`` removes the tables.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, buckets: int, *columns: str) -> DataFrame:
    """``df`` in a scratch table of hash buckets, one file each, sorted by the columns.

    Joins and groupings by these columns read a bucket in one task and need no shuffle.
    """
    path = scratch_path(df.sparkSession, label)
    _tables[path] = f"tonescale_{label}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *columns)
    rows.write.bucketBy(buckets, *columns).sortBy(*columns).format("parquet").option("path", path).saveAsTable(_tables[path])
    return df.sparkSession.table(_tables[path])


def broadcast_if_small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast if Spark's estimate of its size, from its files, is at most ``most_bytes``; else as it is.

    So that the other side of a join, with long rows, need not be shuffled. No job is run for it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this application has made, once no result that reads them is needed any more."""
    return _remove(spark, _made.setdefault(spark.sparkContext.applicationId, []))
