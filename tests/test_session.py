from types import SimpleNamespace

import pytest

from ticketlens.session import clear_scratch, scratch_dir, settle, spread


def session(master, conf=None, context_dir=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: context_dir)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf or default), sparkContext=context)


def test_the_folder_named_by_the_cluster_is_used():
    assert scratch_dir(session("yarn", "hdfs://shared/x/")) == "hdfs://shared/x/ticketlens/app-yarn"
    assert scratch_dir(session("yarn", None, "hdfs://set/y")) == "hdfs://set/y/ticketlens/app-yarn"


@pytest.mark.parametrize("master", ["local[2]", "spark://host"])
def test_a_session_without_a_folder_is_refused(master):
    with pytest.raises(RuntimeError):
        scratch_dir(session(master))


def test_intermediate_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ticketlens.session.scratch_dir", lambda spark: str(tmp_path / "mine"))
    settle(spark.range(3).toDF("id"), "t")
    assert list(tmp_path.rglob("*.parquet"))
    clear_scratch(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_settled_rows_do_not_depend_on_their_source(spark):
    settled = settle(spark.range(5).toDF("id"), "t")
    assert sorted(r.id for r in settled.collect()) == [0, 1, 2, 3, 4]
    assert "Range" not in settled._jdf.queryExecution().toString()


def test_spread_only_where_partitions_are_few(spark):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert spread(many) is many
