"""Keep a table of records up to date as raw files arrive.

The same normalization as the batch build, run on each new set of files.
Dense ticket ids are left to the batch build: they need the whole table, so
arriving records are known by (source, source_key).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize_chats
from ..plans.tickets import unify


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 1000, multi_line: bool = False) -> DataFrame:
    """New CSV files in ``folder``, at most ``max_files`` in a batch, read as ``sources.files`` reads them."""
    options = {"escape": '"', "multiLine": multi_line, "mode": "FAILFAST", "columnPruning": False}
    return spark.readStream.schema(schema).options(**options, maxFilesPerTrigger=max_files).csv(folder)


def write_batch(records: DataFrame, folder: str, batch_id: int) -> None:
    """Store the complete records of one batch under ``folder/batch=<id>``.

    A batch replayed after a failure overwrites its own files, so the table
    holds each arrival once without a look at what is already there.
    """
    unify(records.sparkSession, [records]).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def ingest(
    raw: DataFrame,
    folder: str,
    checkpoint: str,
    normalize: Callable[[DataFrame], DataFrame] = normalize_chats,
    **trigger,
) -> StreamingQuery:
    """Start normalizing the stream ``raw`` into the parquet table ``folder``.

    ``trigger`` as for ``DataStreamWriter.trigger``; by default everything that
    has arrived is taken in and the query ends.
    """
    return (
        raw.writeStream.foreachBatch(lambda batch, batch_id: write_batch(normalize(batch), folder, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
