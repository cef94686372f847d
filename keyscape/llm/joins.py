"""Joins by key that stay even when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.session import materialize

LARGE = 1000
BROADCAST_KEYS = 1_000_000


PART_ROWS = 500_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most about ``rows`` narrow rows, in as many parts as they need."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def join_large(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each ``key`` and
    the number of its rows in ``count``.

    Keys with a thousandth of all ``total`` rows or more are a thousand at most: they
    are broadcast, and their rows don't move. The rest joins by key.
    """
    large = F.col(count) * LARGE >= F.lit(max(total, 1))
    hot = materialize(table.where(large), "large-keys")
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(names, key, "left_anti").join(table.where(~large), key))


def without(docs: DataFrame, gone: DataFrame, on) -> DataFrame:
    """Rows of ``docs`` with no match in the stored table ``gone``, which is broadcast
    if it has at most ``BROADCAST_KEYS`` rows; beyond, Spark joins by key."""
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, on, "left_anti")
