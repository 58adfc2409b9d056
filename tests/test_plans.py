"""Whole plans on small inputs, and the shape of their physical plans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import schemas
from ticketlens.operators import normalize
from ticketlens.operators.embedding import hashed_words, model_embedder
from ticketlens.operators.models import Model, model_column
from ticketlens.plans import moderation, products, replies, search, ticket_reports, tickets
from ticketlens.sources.files import list_objects


CONTACT = replies.Contact("help@example.com", "+1 555 0100")


def rows(df):
    return [tuple(row) for row in df.collect()]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def channels(spark):
    return tickets.Channels(
        forms=spark.createDataFrame([("Slow site", "pages load slowly", "clear the cache", "Technical Support", "low"), ("x", "", "y", None, None), (" ", " ", " ", None, None)], schemas.FORMS),
        chats=spark.createDataFrame([("Customer: my parcel is late\\nAgent: it ships today",), ("Customer: no reply yet",)], schemas.CHATS),
        emails=spark.createDataFrame([("Subject: Refund\\nFrom: a@b.cc\\nTo: c@d.ee\\nCustomer: I want a refund\\nSupport: refund sent",)], schemas.EMAILS),
        calls=spark.createDataFrame([("Customer: no sound\nAgent: restart the radio",)], schemas.TRANSCRIPTS),
    )


@pytest.fixture(scope="module")
def built(spark, channels):
    return tickets.build_tickets(spark, channels)


def test_build_tickets(built):
    assert built.columns == schemas.TICKETS.fieldNames()
    assert [f.dataType for f in built.schema] == [f.dataType for f in schemas.TICKETS]
    got = rows(built.select("ticket_id", "source", "subject", "answer").orderBy("ticket_id"))
    assert [row[0] for row in got] == [1, 2, 3, 4, 5]
    assert [row[1] for row in got] == ["call", "chat", "email", "form", "form"]
    # A lone space is a filled field; an empty one, or a chat without a reply, is not.
    assert {row[2] for row in got} == {"no sound", "my parcel is late", "Refund", "Slow site", " "}


def test_absent_channels_contribute_nothing(spark, channels):
    only = tickets.build_tickets(spark, tickets.Channels(emails=channels.emails))
    assert rows(only.select("ticket_id", "source")) == [(1, "email")]
    assert tickets.build_tickets(spark, tickets.Channels()).count() == 0


def test_rebuild_gives_the_same_ids(spark, channels, built):
    again = tickets.build_tickets(spark, channels)
    assert sorted(rows(again.select("ticket_id", "source_key"))) == sorted(rows(built.select("ticket_id", "source_key")))


def test_search_and_filter_by_channel(spark, built):
    issues = search.embed_queries(spark.createDataFrame([(1, "the parcel is late")], "id long, text string"), "text")
    found = search.search_tickets(built, issues, "id", "query_embedding", k=2).orderBy("rank")
    assert found.columns == ["query_id", "rank", "distance", *search.TICKET_COLUMNS]
    assert found.head()["subject"] == "my parcel is late"
    calls = search.search_tickets(built, issues, "id", "query_embedding", k=2, channel="call")
    assert [r.source for r in calls.collect()] == ["call"]
    vector = issues.head()["query_embedding"]
    assert search.tickets_like(built, vector, 1).head()["subject"] == "my parcel is late"
    assert search.tickets_like(built, vector, 3, channel="email").count() == 1


def test_replies(spark, built):
    issues = spark.createDataFrame([(1, "parcel late"), (2, None), (3, "zzz")], "id long, text string")
    asked = search.embed_queries(issues, "text")
    found = search.search_tickets(built, asked, "id", "query_embedding", k=2)
    prompts = {r.query_id: r.prompt for r in replies.reply_prompts(issues, found, "id", "text").collect()}
    assert set(prompts) == {1, 2, 3}
    assert "it ships today" in prompts[1] and prompts[1].index("parcel late") < prompts[1].index("it ships today")
    assert prompts[2].endswith("Earlier tickets:\n")
    answers = {r.query_id: (r.reply, r.routed) for r in replies.answer_or_route(issues, found, "id", "text", CONTACT, max_distance=0.8).collect()}
    contact = CONTACT.message()
    assert answers == {1: ("it ships today", False), 2: (contact, True), 3: (contact, True)}


def test_questions_about_one_order_are_routed(spark, built):
    issues = spark.createDataFrame([(1, "parcel late"), (2, "parcel late, where is MY ORDER?")], "id long, text string")
    found = search.search_tickets(built, search.embed_queries(issues, "text"), "id", "query_embedding", k=1)
    got = replies.answer_or_route(issues, found, "id", "text", CONTACT, max_distance=2.0)
    assert sorted(rows(got.select("query_id", "routed"))) == [(1, False), (2, True)]


def test_a_search_does_not_shuffle_what_it_shows(spark, tmp_path, built):
    path = str(tmp_path / "tickets")
    built.write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        issues = search.embed_queries(spark.createDataFrame([(1, "late")], "id long, text string"), "text")
        found = search.search_tickets(spark.read.parquet(path), issues, "id", "query_embedding", k=2)
        found.collect()
        physical = plan(found).split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_a_ticket_in_another_script_is_found(spark):
    calls = spark.createDataFrame([("Customer: где мой заказ\nAgent: он в пути",), ("Customer: no sound\nAgent: restart",)], schemas.TRANSCRIPTS)
    built = tickets.build_tickets(spark, tickets.Channels(calls=calls))
    issues = search.embed_queries(spark.createDataFrame([(1, "Заказ?")], "id long, text string"), "text")
    assert search.search_tickets(built, issues, "id", "query_embedding", k=1).head()["answer"] == "он в пути"


def test_generators(spark):
    issues = spark.createDataFrame([(1, "good"), (2, "blank"), (3, "fail")], "id long, text string")
    nothing = spark.createDataFrame([], "query_id long, rank long, distance double, subject string, body string, answer string")

    def generate(prompts):
        if any("fail" in p.split("Issue:")[1] for p in prompts):
            raise RuntimeError("model down")
        return ["  " if "blank" in p.split("Issue:")[1] else " fine " for p in prompts]

    generator = model_column(Model(lambda: generate), T.StringType())
    answers = {r.query_id: (r.reply, r.routed) for r in replies.answer_or_route(issues, nothing, "id", "text", CONTACT, generator=generator).collect()}
    contact = CONTACT.message()
    assert answers == {1: ("fine", False), 2: (contact, True), 3: (contact, True)}
    drafted = replies.draft(replies.reply_prompts(issues, nothing, "id", "text"), generator)
    assert {r.query_id: r.reply for r in drafted.collect()} == {1: "fine", 2: "", 3: ""}


def test_build_products_with_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"aa")
    (tmp_path / "unused.jpg").write_bytes(b"boom")
    df = spark.createDataFrame(
        [("P1", "Toy", "for cats", "a.jpg"), ("P2", None, "for dogs", "a.jpg"), ("P3", "x", None, "gone.jpg"), ("P4", None, None, None)],
        "product_id string, title string, description string, image string",
    )

    def look(images):
        assert b"boom" not in [bytes(i) for i in images]
        return [[float(len(i)), 1.0] for i in images]

    embedder = model_embedder(Model(lambda: look, on_error="raise"))
    got = products.build_products(df, None, str(tmp_path), list_objects(spark, str(tmp_path), "*.jpg"), embedder)
    by_id = {r.product_id: r for r in got.collect()}
    assert by_id["P1"].img_embedding == by_id["P2"].img_embedding == [2.0, 1.0]
    assert by_id["P3"].img_embedding is None and by_id["P4"].img_embedding is None
    assert by_id["P1"].uri.endswith("/a.jpg") and by_id["P4"].uri is None
    assert by_id["P2"].text_embedding is not None and by_id["P4"].text_embedding is None
    # By image: one uploaded picture embedded the same way, then a search on the other vector column.
    uploads = search.embed_images(list_objects(spark, str(tmp_path), "a.jpg"), embedder)
    upload = uploads.head()["query_embedding"]
    assert {r.product_id for r in search.products_like(got, upload, 2, "img_embedding").collect()} == {"P1", "P2"}
    found = search.search_products(got, uploads, "path", "query_embedding", k=5, base_vector="img_embedding")
    assert [(r.product_id, r.distance) for r in found.orderBy("rank").collect()] == [("P1", 0.0), ("P2", 0.0)]


def test_products_without_images(spark):
    df = spark.createDataFrame([("P1", "a", "b", "c.jpg")], "product_id string, title string, description string, image string")
    got = products.build_products(df)
    assert rows(got.select("uri", "img_embedding")) == [(None, None)]


def test_product_cards(spark):
    df = spark.createDataFrame([("P1", None, "d" * 201, "gs://b/x.jpg"), ("P2", "t", None, None)], "product_id string, title string, description string, uri string")
    assert rows(products.product_cards(df)) == [
        ("P1", "", "d" * 200 + "…", "https://storage.googleapis.com/b/x.jpg"),
        ("P2", "t", "", None),
    ]


def test_abuse_model_learns_its_words(spark):
    texts = [(i, f"you are an idiot number {'abc'[i % 3]}" if i % 4 == 0 else f"a kind word {'xyz'[i % 3]}", int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(texts, "id long, t string, toxic int")
    model = moderation.train_abuse_model(df.where("id < 60"), "t", "toxic")
    flagged = moderation.flag_abuse(df.where("id >= 60"), "id", "t", model)
    assert flagged.columns == ["id", "t", "toxic", "abusive"]
    assert all(r.abusive == bool(r.toxic) for r in flagged.collect())
    assert moderation.flag_abuse(spark.createDataFrame([(1, None)], "id long, t string"), "id", "t", model).count() == 1


# --- physical plans ----------------------------------------------------------


def test_a_model_runs_once_though_filtered_and_returned(spark):
    flag = model_column(Model(lambda: lambda texts: [True for _ in texts]), T.BooleanType())
    df = spark.range(10).select(F.col("id").cast("string").alias("t")).withColumn("flag", flag(F.col("t")))
    assert plan(df.where("flag").select("t", "flag").where("flag")).split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1


def test_top_reports_keep_only_the_top(spark, built):
    scored = ticket_reports.score_tickets(built)
    assert "TakeOrderedAndProject" in plan(ticket_reports.riskiest_tickets(scored))
    assert "TakeOrderedAndProject" in plan(ticket_reports.top_types(scored))


def test_complete_record_filter_does_not_repeat_the_parsing(spark, channels):
    chats = tickets.unify(spark, tickets.records(tickets.Channels(chats=channels.chats)))
    physical = plan(chats).split("== Physical Plan ==")[1]
    below_generate = physical[physical.index("Generate") :].split("\n", 1)[1]
    assert physical.count("Generate") == 1
    assert "subject" not in below_generate.split("Filter")[-1]


def test_channel_filter_reads_only_that_channel(spark, channels):
    unified = tickets.unify(spark, tickets.records(channels))
    optimized = plan(unified.where("source = 'email'")).split("== Optimized Logical Plan ==")[1].split("== Physical")[0]
    assert optimized.count("LogicalRDD") == 1


def test_reports_read_only_their_columns(spark, tmp_path, built):
    path = str(tmp_path / "scored")
    ticket_reports.score_tickets(built).write.parquet(path)
    stored = spark.read.parquet(path)
    for report, columns in [
        (ticket_reports.ticket_kpis(stored), {"priority", "sentiment"}),
        (ticket_reports.churn_kpis(stored), {"churn"}),
        (ticket_reports.priority_distribution(stored), {"priority"}),
    ]:
        physical = plan(report).split("== Physical Plan ==")[1]
        schema = physical.split("ReadSchema: struct<")[1].split(">")[0]
        assert {part.split(":")[0] for part in schema.split(",")} == columns


def test_vectors_are_filled_without_a_shuffle(spark, built):
    filled = tickets.add_ticket_vectors(spark.createDataFrame([("a", "b")], "subject string, body string"), hashed_words(), "missing")
    assert "Exchange" not in plan(filled).split("== Physical Plan ==")[1]


def test_generated_methods_are_short_enough_to_be_compiled(spark, channels):
    """The JVM interprets methods of more than 8000 bytes, several times slower."""
    import re

    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    for df in (tickets.unify(spark, tickets.records(channels)), ticket_reports.score_tickets(tickets.unify(spark, tickets.records(channels)))):
        code = getattr(debug, "MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_a_mail_is_rid_of_its_tails_once(spark):
    """Once for the body and once for the answer, not again for whether anything is left."""
    mails = spark.createDataFrame([("Subject: a\nCustomer: b\nSupport: c\nCustomer: >q",), ("Subject: a\nCustomer:  \nSupport: c",)], "email string")
    parts = normalize.email_parts(mails)
    assert [tuple(r) for r in parts.select("_body", "_answer").collect()] == [("b", "c"), (None, "c")]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("confidentiality notice") <= 2
