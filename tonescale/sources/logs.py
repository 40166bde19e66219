"""Loss logs: ``epoch,loss`` lines without a header, or a table partitioned by run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescale.sources.reports import run_of

_LINE = "epoch int, loss double"


def read_loss_log(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """``(run, epoch, loss)`` of one log or a folder of them. An absent optional log gives ``None``.

    The run is the folder ``run=...`` a log lies in, as ``write_loss_log`` lays them down, else the name of its file.
    """
    try:
        log = spark.read.schema(_LINE).option("recursiveFileLookup", True).csv(path)
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return log.select(run_of(F.col("_metadata.file_path")).alias("run"), "epoch", "loss")


def write_loss_log(losses: DataFrame, path: str, column: str = "loss") -> None:
    """Lines ``epoch,loss`` with four decimals, in epoch order, one folder per run."""
    slim = losses.select("run", "epoch", F.format_string("%.4f", F.col(column)).alias("loss"))
    slim.repartition("run").sortWithinPartitions("run", "epoch").write.mode("overwrite").partitionBy("run").csv(path)


def append_losses(losses: DataFrame, path: str, by: tuple[str, ...] = ("run",)) -> None:
    """Replace the records of the runs in ``losses`` and leave other runs alone.

    With ``by=("run", "epoch")``, for a log that grows by an epoch at a time, only the records of those epochs are replaced:
    an epoch that is written again after a failure is there once. A log keeps the layout it began with.
    """
    losses.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
