"""Column-level table changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_filled, with_slash


def add_column_if_missing(df: DataFrame, name: str, dtype: T.DataType | str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def fill_uri(df: DataFrame, prefix: str, image_col: str = "image", uri_col: str = "uri") -> DataFrame:
    """Set a missing uri to ``prefix`` + image name. No prefix, no change."""
    prefix = with_slash(prefix)
    if not prefix:
        return df
    uri, image = F.col(uri_col), F.col(image_col)
    return df.withColumn(
        uri_col,
        F.when(uri.isNull() & is_filled(image), F.concat(F.lit(prefix), image)).otherwise(uri),
    )


def keep_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[name for name in names if name in df.columns])
