"""Keys for rows whose own columns may hold anything."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.session import broadcast_if_small, materialize


def free_name(wish: str, columns: Iterable[str]) -> str:
    """``wish``, with underscores before it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` in a scratch table with one more column, and its name: a key of each row, whatever the other columns hold."""
    key = free_name("row", df.columns)
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), label), key


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` but those whose key is in ``dropped``, which is stored first: so its size is known, and the texts stay where they are while it is small."""
    return rows.join(broadcast_if_small(materialize(dropped.select(key), "dropped")), key, "left_anti")
