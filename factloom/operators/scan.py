"""Running sums and maxima per key without a task that sees a whole key.

Rows are range-partitioned by key and order, so a key of any size spreads over
as many partitions as its rows need. Each partition scans its own rows; what a
key has gathered in the partitions before comes from one small row per key and
partition, and is added behind. Ties in the order are broken by the place of the
row, so a heap of equal rows may be parted as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.session import checkpoint

#: Rows of one range partition, which is the most that a window ever holds.
PART_ROWS = 100_000
_KINDS = {"sum": F.sum, "max": F.max}


def dealt(rows: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` in range partitions, with ``_part`` and ``_tie`` for ``scanned``; computed once."""
    rows = checkpoint(rows)
    parts = max(1, -(-rows.count() // part_rows))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    return checkpoint(tied.repartitionByRange(parts, *keys, *order, "_tie").withColumn("_part", F.spark_partition_id()))


def scanned(rows: DataFrame, keys: list[str], order: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """``rows`` from ``dealt`` with a column for each ``name=(kind, value)``: the sum (0 at first) or the maximum (null at first)
    of ``value`` over all earlier rows of the key. Null keys are a key of their own.
    """
    here = W.partitionBy(*keys, "_part").orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    own = [f"_key{i}" for i in range(len(keys))]
    totals = rows.groupBy(*keys, "_part").agg(*[_KINDS[kind](value).alias(name) for name, (kind, value) in wanted.items()])
    totals = totals.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("_part").alias("_of"),
                           *[_KINDS[kind](name).over(before).alias(f"_from_{name}") for name, (kind, _) in wanted.items()])
    local = rows.withColumns({name: _KINDS[kind](value).over(here) for name, (kind, value) in wanted.items()})
    met = F.col("_part") == F.col("_of")
    for k, o in zip(keys, own):
        met = met & F.col(k).eqNullSafe(F.col(o))
    out = local.join(totals, met)
    both = {name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_from_{name}"), F.lit(0)) if kind == "sum"
            else F.greatest(name, f"_from_{name}") for name, (kind, _) in wanted.items()}
    return out.withColumns(both).select(*rows.columns, *wanted)
