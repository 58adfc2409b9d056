"""Stored tables: scan, and create-or-replace from a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalogue table by name, or a parquet folder by path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def _drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def recover_table(spark: SparkSession, name: str) -> None:
    """Undo a swap that was cut off between its two renames."""
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}__retired"):
        spark.sql(f"ALTER TABLE {name}__retired RENAME TO {name}")


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace table ``name`` with the rows of ``df``.

    The rows are written in full under another name first and swapped in by two renames,
    so ``df`` may read ``name`` itself, and a failed write leaves it untouched. A reader between the renames finds no
    table; after a crash there, the next call (or :func:`recover_table`) puts the old one back first.
    """
    spark = df.sparkSession
    staged, retired = f"{name}__staged", f"{name}__retired"
    recover_table(spark, name)
    _drop_table(spark, staged)
    df.write.format("parquet").mode("overwrite").saveAsTable(staged)
    _drop_table(spark, retired)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {retired}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    _drop_table(spark, retired)
    return spark.table(name)
