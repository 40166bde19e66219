"""Early stopping over loss logs of any number of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stopping(losses: DataFrame, patience: int = 3, max_epochs: int | None = None, by: str = "run") -> DataFrame:
    """Where each run stops, and the epoch whose model is kept.

    ``losses`` has one row per run and epoch (``epoch`` counts from 1). An epoch
    improves if its loss is below all before it; NaN never does. A run stops at the
    first epoch that ends ``patience`` epochs in a row without improvement. All runs
    are done in one shuffle; a run is as long as its number of epochs.
    """
    if max_epochs is not None:
        losses = losses.filter(F.col("epoch") <= F.lit(max_epochs))
    ordered = Window.partitionBy(by).orderBy("epoch")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    loss = F.nanvl(F.col("loss").cast("double"), F.lit(None).cast("double"))
    best_before = F.coalesce(F.min("__loss").over(so_far), F.lit(float("inf")))
    marked = (
        losses.withColumn("__loss", loss)
        .withColumn("improved", F.coalesce(F.col("__loss") < best_before, F.lit(False)))
        .withColumn(
            "__best",
            F.coalesce(
                F.max(F.when(F.col("improved"), F.col("epoch"))).over(
                    ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                ),
                F.lit(0),
            ),
        )
        .withColumn("__stop", F.min(F.when(F.col("epoch") - F.col("__best") >= patience, F.col("epoch"))).over(whole))
        .withColumn("__last", F.coalesce("__stop", F.max("epoch").over(whole)))
    )
    kept = F.when(F.col("improved") & (F.col("epoch") <= F.col("__last")), F.col("epoch"))
    return marked.groupBy(by).agg(
        F.max("__last").alias("epochs_run"),
        F.max("__stop").isNotNull().alias("stopped_early"),
        F.max(kept).alias("best_epoch"),
        F.max_by("__loss", kept).alias("best_loss"),
    )
