"""Update a table from another one by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


class DuplicateKeyError(ValueError):
    """An update names the same key more than once."""


def keyed_update(base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with ``columns`` taken from the row of ``updates`` having its key.

    A matched row takes the new value even when that is NULL; the rest keep the
    old one. Keys must be unique in ``updates``; that is checked first. NULL keys never match.
    Eager: the update is written once, so that the check does not compute it a second time.

    Both sides then meet in a plain equi-join with nothing between shuffle and
    join, so a small update side is broadcast by its measured size, and
    otherwise adaptive execution can split a key that holds much of ``base``.
    """
    named = settle(updates.where(F.col(key).isNotNull()).select(key, *columns), "updates")
    repeated = named.groupBy(key).count().where("count > 1").select(key).head(3)
    if repeated:
        raise DuplicateKeyError(f"{key} repeats in the update: {[row[0] for row in repeated]}")
    new = named.select(key, F.struct(*columns).alias("_new"))
    joined = base.join(new, key, "left")
    matched = F.col("_new").isNotNull()
    return joined.select(
        *[
            F.when(matched, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )
