"""Dense row numbers without putting all rows in one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

# monotonically_increasing_id() holds the row's place within its partition in
# its low 33 bits.
_PLACE_BITS = (1 << 33) - 1


def dense_ids(df: DataFrame, order: Sequence[str], out: str = "ticket_id") -> DataFrame:
    """Number the rows 1..n in ``order``; rows equal in it are numbered in any order.

    ``df`` is computed once and stored with a number of each row's own. Only the
    ``order`` columns and that number are range-partitioned and sorted (finding
    the ranges takes a pass of its own, which must not repeat what made ``df``).
    The offset of a partition is the sum of the sizes before it, so just one row
    per partition ever meets in a single task. The own number is the last range
    key, so a value of ``order`` that many rows share is still cut into several
    partitions. Whole rows are shuffled once, to receive their id. Eager: rows and places are written.
    """
    rows = settle(df.withColumn("_at", F.monotonically_increasing_id()), "unnumbered")
    placed = settle(
        rows.select(*order, "_at")
        .repartitionByRange(*order, "_at")
        .sortWithinPartitions(*order, "_at")
        .select(
            "_at",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)).alias("_place"),
        ),
        "placed",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per partition of the write, so at most the partition count.
    ids = placed.join(F.broadcast(offsets), "_part").select(
        "_at", (F.col("_offset") + F.col("_place") + 1).cast("long").alias(out)
    )
    return rows.join(ids, "_at").select(out, *df.columns)
