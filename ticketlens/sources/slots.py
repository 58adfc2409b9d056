"""Tables kept in slots of their key, of which an update rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.update import keyed_update
from ..session import discard, settle

SLOT = "slot"


def slot_of(key: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def write_slots(df: DataFrame, name: str, key: str, slots: int = 256, buckets: int = 8) -> DataFrame:
    """Store ``df`` as table ``name``: a folder for each of ``slots`` hashes of the key, and in it files bucketed by the key.

    A join on the key then reads the table as it lies, without a shuffle of it. A key of very many rows is in one
    slot and file; keys of a keyed update are unique.
    """
    rows = df.withColumn(SLOT, slot_of(key, slots)).repartition(buckets, key)
    rows.write.format("parquet").mode("overwrite").partitionBy(SLOT).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('slots' = '{slots}', 'slot_key' = '{key}', 'slot_buckets' = '{buckets}')")
    return df.sparkSession.table(name)


def keyed_update_slots(spark: SparkSession, name: str, updates: DataFrame, columns: Sequence[str]) -> list[int]:
    """Update ``columns`` of the stored table from the rows of ``updates`` with the same key; gives the slots that were rewritten.

    Like ``keyed_update``, but slots without a key of the update are neither read nor written. The new rows are written aside in full before any slot is
    overwritten; the overwrite replaces slot after slot, so after a crash in it some are new and some old, and the
    same update, which changes nothing where it has been, completes it. Eager; one number per slot is collected.
    """
    properties = {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    key, slots, buckets = properties["slot_key"], int(properties["slots"]), int(properties["slot_buckets"])
    new = settle(updates.where(F.col(key).isNotNull()).select(key, *columns), "slot-updates")
    touched = sorted(row[0] for row in new.select(slot_of(key, slots)).distinct().collect())
    if touched:
        base = spark.table(name).where(F.col(SLOT).isin(touched))
        changed = settle(keyed_update(base, new, key, columns), "slots")
        former = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            changed.select(spark.table(name).columns).repartition(buckets, key).write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", former)
        discard(changed)
        spark.catalog.refreshTable(name)
    discard(new)
    return touched
