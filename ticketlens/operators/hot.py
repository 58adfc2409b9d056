"""A left join in which few keys may hold much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_hot(df: DataFrame, small: DataFrame, key: str, hot_rows: int = 1_000_000, most_hot: int = 1_000) -> DataFrame:
    """``df`` left join ``small`` by ``key``, a string that is unique in ``small``.

    The up to ``most_hot`` keys of more than ``hot_rows`` rows of ``df``, the ones of most rows first, are hot: their rows of ``small`` go to every
    task, at most 1,000 rows whatever the data. All others meet in a shuffle, in which rows with a hot key or none
    are dealt by a hash of the row, the same when a task is run again. A key that is hot but beyond ``most_hot`` is met like any other; adaptive
    execution splits it. Columns of ``small`` besides the key follow those of ``df``.
    """
    values = [c for c in small.columns if c != key]
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot_rows)
    hottest = counts.orderBy(F.desc("count"), key).limit(most_hot).select(key)
    packed = small.select(key, F.struct(*values).alias("_small"))
    matched = packed.join(F.broadcast(hottest), key)  # reads ``small`` without a shuffle
    hot = hottest.join(F.broadcast(matched), key, "left").withColumnRenamed("_small", "_hot").withColumn("_is_hot", F.lit(True))
    marked = df.join(F.broadcast(hot), key, "left")
    apart = F.col(key).isNull() | F.col("_is_hot")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string")
    spread = F.when(F.coalesce(apart, F.lit(False)), F.concat(F.lit("\x00"), row)).otherwise(F.col(key))
    joined = marked.withColumn("_key", spread).join(packed.withColumnRenamed(key, "_key"), "_key", "left")
    found = F.coalesce("_hot", "_small")
    return joined.select(*df.columns, *[found[c].alias(c) for c in values])
