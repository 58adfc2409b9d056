"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster the caller brings its own session; nothing in this package
    depends on these settings. Further settings go in ``conf`` by their full name. Without
    ``spark.checkpoint.dir`` among them, a temporary folder is it: one machine holds everything here.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ticketlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    conf.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ticketlens-"))
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the one named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{configured.rstrip('/')}/ticketlens/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.

    For the time when results have been written: whatever still reads an intermediate table
    fails from then on. Without this call they stay until the folder is cleaned.
    """
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the scratch folder, with the writer's ``options``, and read it back.

    Cuts the lineage at a durable table, so several later passes see the same
    rows even when executors are lost in between, and each pass reads only the
    columns it needs. Eager. :func:`clear_scratch` deletes the tables.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def discard(*tables: DataFrame) -> None:
    """Delete tables returned by :func:`settle` that no later step reads."""
    for table in tables:
        _delete(table.sparkSession, table._settled_at)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where ``df`` comes in fewer partitions than there are.

    For heavy work per row on a small input, such as one parquet row group. An
    input of many splits is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
