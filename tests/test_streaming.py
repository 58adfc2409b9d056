from ticketlens import schemas
from ticketlens.operators.normalize import normalize_chats
from ticketlens.plans.tickets import unify
from ticketlens.sources.files import read_chats
from ticketlens.streaming.ingest import file_stream, ingest, write_batch


def cell(text):
    return '"' + text.replace('"', '""') + '"\n'


def test_arrivals_give_the_same_records_as_one_batch(spark, tmp_path):
    chats, table = tmp_path / "chats", str(tmp_path / "records")
    chats.mkdir()
    one, two = "Customer: it broke\\nAgent: we mend it", "Customer: late\\nAgent: it ships"

    def run():
        ingest(file_stream(spark, str(chats), schemas.CHATS), table, str(tmp_path / "state")).awaitTermination()
        return sorted(r.body for r in spark.read.parquet(table).collect())

    (chats / "a.csv").write_text(cell(one) + cell("Customer: no reply"))
    assert run() == ["it broke"]
    (chats / "b.csv").write_text(cell(two) + cell(one))
    assert run() == ["it broke", "it broke", "late"]
    assert run() == ["it broke", "it broke", "late"]

    names = schemas.RECORD.fieldNames()
    whole = unify(spark, [normalize_chats(read_chats(spark, str(chats)))]).select(names)
    stored = spark.read.parquet(table).select(names)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, whole.collect()))


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    records = normalize_chats(spark.createDataFrame([("Customer: a\\nAgent: b",)], schemas.CHATS))
    for batch_id in (0, 1, 1):
        write_batch(records, str(tmp_path / "t"), batch_id)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
