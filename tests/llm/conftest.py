import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, in three partitions."""

    def make(rows, schema=SCHEMA, **extra):
        table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema).repartition(3)
        return table.selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])

    return make
