from tonescale.sources.logs import append_losses, read_loss_log, write_loss_log
from tonescale.sources.reports import read_reports, write_reports
from tonescale.sources.stored import open_bucketed, store_bucketed, write_aligned, write_counted, write_splits_counted
from tonescale.sources.tables import (
    import_annotated,
    read_annotated,
    read_texts,
    write_csv,
    write_predictions,
    write_splits,
)

__all__ = [
    "append_losses",
    "import_annotated",
    "open_bucketed",
    "read_annotated",
    "read_loss_log",
    "read_reports",
    "read_texts",
    "store_bucketed",
    "write_aligned",
    "write_counted",
    "write_csv",
    "write_loss_log",
    "write_predictions",
    "write_reports",
    "write_splits",
    "write_splits_counted",
]
