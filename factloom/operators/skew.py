"""Joins whose key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy above this share of all rows, so fewer than ``PARTS`` keys can be.
PARTS = 500
#: Keys of fewer rows are never worth a broadcast.
LEAST = 500


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and in ``weight`` how many rows hold the key.

    Keys with more than a ``PARTS``-th of the ``total`` rows are fewer than
    ``PARTS`` by counting alone, so they go out by broadcast and their rows stay
    where they are; all others meet in an ordinary join, where no key can fill a
    task. Null keys find nothing. ``rows`` is read twice and should be stored.
    """
    heavy = F.col(weight) > max(LEAST, total // PARTS)
    few = table.where(heavy)
    spread = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(~heavy), keys)
    return rows.join(F.broadcast(few), keys).unionByName(spread)
