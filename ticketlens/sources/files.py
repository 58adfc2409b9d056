"""Readers for the raw inputs. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _quoted_csv(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    # Cells hold commas and doubled quotes. All columns are parsed, also those a query
    # does not use: else a row that is too long could pass unseen.
    options = {"escape": '"', "multiLine": multi_line, "mode": "FAILFAST", "columnPruning": False}
    return spark.read.options(**options)


def read_chats(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One chat per row, no header. A row of more than one cell fails the job.

    Line breaks inside cells are the two characters \\n; a file with real ones needs
    ``multi_line``, and is then read by one task per file.
    """
    return _quoted_csv(spark, multi_line).schema(schemas.CHATS).csv(path)


def read_emails(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One email per row, no header; otherwise as for chats."""
    return _quoted_csv(spark, multi_line).schema(schemas.EMAILS).csv(path)


def read_forms(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Form submissions; columns are found by the names in the header row, others are left out.

    An empty cell is NULL. A missing name is an error, a row longer or shorter than the header fails the job. Files under one path
    have the same header. Eager: it reads the header.
    """
    found = _quoted_csv(spark, multi_line).option("header", True).csv(path)
    by_name = {name.strip().lower(): name for name in found.columns}
    missing = [name for name in schemas.FORMS.fieldNames() if name not in by_name]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {found.columns}")
    return found.select(*[F.col(f"`{by_name[name]}`").alias(name) for name in schemas.FORMS.fieldNames()])


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON with nested arrays; a broken record fails the job."""
    return spark.read.schema(schemas.PRODUCTS).option("mode", "FAILFAST").json(path)


def list_objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files under ``folder``: path, modificationTime, length and content.

    A query that does not use ``content`` never opens the files.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )


def object_key(path: Column) -> Column:
    """A path in the one form used for joins: ``file:/x`` for all local spellings."""
    return F.regexp_replace(path, "^(?:file:)?/+", "file:/")


def wanted_objects(objects: DataFrame, uris: DataFrame, uri_col: str) -> DataFrame:
    """The objects named by a filled ``uri_col``, each once, with their content."""
    wanted = (
        uris.where(F.col(uri_col).isNotNull() & (F.col(uri_col) != ""))
        .select(object_key(F.col(uri_col)).alias("object_key"))
        .distinct()
    )
    return objects.withColumn("object_key", object_key(F.col("path"))).join(wanted, "object_key", "left_semi")
