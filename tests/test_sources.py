import json

import pytest
from pyspark.sql import functions as F

from ticketlens.operators.columns import add_column_if_missing, fill_uri, keep_present
from ticketlens.sources import files, tables


def test_single_column_csv(spark, tmp_path):
    path = tmp_path / "chats.csv"
    path.write_text('"""Customer: Hi, one.\\nAgent: Yes, sure."""\n"""Customer: say ""no"", please"""\n')
    got = [row[0] for row in files.read_chats(spark, str(path)).collect()]
    assert got == ['"Customer: Hi, one.\\nAgent: Yes, sure."', '"Customer: say "no", please"']
    assert files.read_emails(spark, str(path)).columns == ["email"]


def test_forms_with_header(spark, tmp_path):
    path = tmp_path / "forms.csv"
    path.write_text('subject,body,answer,type,priority\n"a, b",c,"line 1\nline 2",Other,\n')
    (row,) = files.read_forms(spark, str(path), multi_line=True).collect()
    assert tuple(row) == ("a, b", "c", "line 1\nline 2", "Other", None)


def test_forms_are_read_by_name(spark, tmp_path):
    path = tmp_path / "forms.csv"
    path.write_text("Priority,type,queue,subject, body,answer\nhigh,Other,q1,s,b,a\n")
    (row,) = files.read_forms(spark, str(path)).collect()
    assert row.asDict() == {"subject": "s", "body": "b", "answer": "a", "type": "Other", "priority": "high"}
    path.write_text("subject,body\ns,b\n")
    with pytest.raises(ValueError, match="no column answer, type, priority"):
        files.read_forms(spark, str(path))


@pytest.mark.parametrize("row", ["s,b,a,t,p,more", "s,b,a"])
def test_a_form_of_another_length_fails(spark, tmp_path, row):
    path = tmp_path / "forms.csv"
    path.write_text(f"subject,body,answer,type,priority\ns,b,a,t,p\n{row}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_forms(spark, str(path)).select("subject").collect()


def test_an_unquoted_chat_fails(spark, tmp_path):
    path = tmp_path / "chats.csv"
    path.write_text("Customer: Hi, my bag broke\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_chats(spark, str(path)).collect()


def test_a_large_file_is_read_in_parts(spark, tmp_path):
    path = tmp_path / "chats.csv"
    path.write_text('"Customer: a, b"\n' * 20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        chats = files.read_chats(spark, str(path))
        assert chats.rdd.getNumPartitions() >= 4 and chats.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_products_json(spark, tmp_path):
    path = tmp_path / "products.jsonl"
    lines = [
        {"product_id": "P1", "title": "Toy", "price": 9.5, "categories": ["a", "b"], "customer_comments": ["ok", None]},
        {"product_id": "P2"},
    ]
    path.write_text("\n".join(json.dumps(line) for line in lines))
    one, two = files.read_products(spark, str(path)).orderBy("product_id").collect()
    assert (one.price, one.categories, one.customer_comments) == (9.5, ["a", "b"], ["ok", None])
    assert two.title is None and two.categories is None


def test_a_broken_product_fails(spark, tmp_path):
    path = tmp_path / "products.jsonl"
    path.write_text('{"product_id": "P1"}\n{"product_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_products(spark, str(path)).collect()


def test_a_swap_that_was_cut_off_is_undone(spark):
    name = "cut_off"
    tables.replace_table(spark.range(2).toDF("id"), name)
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__retired")  # where the crash came
    tables.recover_table(spark, name)
    assert spark.table(name).count() == 2
    assert tables.replace_table(spark.range(3).toDF("id"), name).count() == 3
    spark.sql(f"DROP TABLE {name}")


def test_objects_are_listed_and_joined_by_path(spark, tmp_path):
    for name in ("a.wav", "b.wav", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    objects = files.list_objects(spark, str(tmp_path), "*.wav")
    assert objects.columns == ["path", "modificationTime", "length", "content"]
    assert objects.count() == 2
    uris = spark.createDataFrame([(f"file://{tmp_path}/a.wav",), (f"{tmp_path}/a.wav",), ("",), (None,)], "uri string")
    (found,) = files.wanted_objects(objects, uris, "uri").collect()
    assert bytes(found.content) == b"a.wav"


def test_replace_table_may_read_what_it_replaces(spark):
    name = "replace_me"
    tables.replace_table(spark.range(3).toDF("id"), name)
    again = tables.replace_table(tables.scan(spark, name).withColumn("twice", F.col("id") * 2), name)
    assert sorted(tuple(r) for r in again.collect()) == [(0, 0), (1, 2), (2, 4)]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    spark.sql(f"DROP TABLE {name}")


def test_a_failed_write_leaves_the_table(spark):
    name = "keep_me"
    tables.replace_table(spark.range(2).toDF("id"), name)
    broken = spark.range(2).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    try:
        tables.replace_table(broken, name)
    except Exception:
        pass
    assert spark.table(name).count() == 2
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}__staged")


def test_add_column_if_missing(spark):
    df = spark.range(1).toDF("id")
    added = add_column_if_missing(df, "v", "array<double>")
    assert dict(added.dtypes)["v"] == "array<double>"
    assert add_column_if_missing(added, "v", "string") is added


def test_fill_uri(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("x.jpg", None), ("y.jpg", "gs://old")], "image string, uri string")
    for prefix in ("gs://b", "gs://b/"):
        assert [r.uri for r in fill_uri(df, prefix).collect()] == [None, None, "gs://b/x.jpg", "gs://old"]
    assert fill_uri(df, "") is df


def test_keep_present(spark):
    assert keep_present(spark.range(1).withColumn("a", F.lit(1)), ["a", "b", "id"]).columns == ["a", "id"]
