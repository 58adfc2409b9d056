import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import schemas
from ticketlens.operators import embedding, ids, normalize, scoring, transcripts, update
from ticketlens.operators.models import Model, model_column
from ticketlens.session import settle


def rows(df):
    return [tuple(row) for row in df.collect()]


# --- keyed update ------------------------------------------------------------


def test_keyed_update(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (None, "n", 9.0)], "id long, s string, x double")
    new = spark.createDataFrame([(2, 20.0), (3, None), (4, 40.0), (None, 0.0)], "id long, x double")
    got = rows(update.keyed_update(base, new, "id", ["x"]).orderBy("s"))
    assert got == [(1, "a", 1.0), (2, "b", 20.0), (3, "c", None), (None, "n", 9.0)]


def test_keyed_update_refuses_duplicates(spark):
    base = spark.range(3).toDF("id").withColumn("x", F.lit(0))
    twice = spark.createDataFrame([(1, 1), (1, 2)], "id long, x int")
    with pytest.raises(update.DuplicateKeyError):
        update.keyed_update(base, twice, "id", ["x"])


# --- dense ids ---------------------------------------------------------------


def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 3).alias("source"))
    got = rows(ids.dense_ids(df.repartition(7), ["source", "key"], "n").select("n", "source", "key"))
    expected = sorted((row[1], row[2]) for row in got)
    assert [(s, k) for _, s, k in sorted(got)] == expected
    assert sorted(n for n, _, _ in got) == list(range(1, 1001))


def test_a_key_shared_by_most_rows_is_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    numbered = ids.dense_ids(df.repartition(5), ["key"], "n")
    assert numbered.agg(F.min("n"), F.max("n"), F.countDistinct("n")).head() == (1, 20_000, 20_000)
    hot = numbered.where("key = 'hot'").agg(F.max("n") - F.min("n")).head()[0]
    assert hot == 13_999


def test_dense_ids_of_nothing(spark):
    assert ids.dense_ids(spark.createDataFrame([], "key string"), ["key"]).count() == 0


# --- transcripts and normalization ------------------------------------------


def test_transcripts_in_turn_order_over_blocks(spark):
    turns = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in (3, 1, 2, 0, 4)]
    turns += [(1, 5, "system", "hidden"), (2, 0, "user", None), (3, 0, "user", "x")]
    df = spark.createDataFrame(turns, schemas.TURNS)
    for block in (1, 2, 3, 1000):
        got = rows(transcripts.assemble_transcripts(df, block_turns=block).orderBy("conv_id"))
        assert got == [(1, "Agent: t0\nCustomer: t1\nAgent: t2\nCustomer: t3\nAgent: t4"), (3, "Customer: x")]


def test_a_long_conversation_is_one_ticket_with_all_turns(spark):
    turns = [(1, t, "user" if t < 1500 else "assistant", f"turn{t}.") for t in range(2500)]
    said = transcripts.assemble_transcripts(spark.createDataFrame(turns, schemas.TURNS).repartition(7))
    (row,) = normalize.normalize_calls(said).collect()
    assert row.body.split() == [f"turn{t}." for t in range(1500)]
    assert row.answer.split() == [f"turn{t}." for t in range(1500, 2500)]


FIELDS = ["subject", "body", "answer", "type", "priority"]


def chat(spark, *cells):
    return rows(normalize.normalize_chats(spark.createDataFrame([(c,) for c in cells], "chat string")).select(*FIELDS))


def test_chat(spark):
    cell = (
        '"Customer: Hi, this is Ada Doe. My order K553311 is stuck, says "lost".\\nAgent: Hello Ms. Doe. I look.'
        '\\nAgent: A trace is open.\\nCustomer: Mail me at ada@x.org, please."'
    )
    assert chat(spark, cell) == [
        (
            'My order [ORDER] is stuck, says "lost".',
            'My order [ORDER] is stuck, says "lost". Mail me at [EMAIL], please.',
            "I look. A trace is open.",
            "Other",
            "high",
        )
    ]


def test_a_name_recognizer_gets_the_redacted_text(spark):
    nameless = model_column(Model(lambda: lambda texts: [t.replace("Ada", "[NAME]") for t in texts]), T.StringType())
    df = spark.createDataFrame([("Customer: Ada a@b.cc\nAgent: dear Ada",)], schemas.CHATS)
    (row,) = normalize.normalize_chats(df, rules=normalize.Rules(names=nameless)).collect()
    assert (row.subject, row.body, row.answer) == ("[NAME] [EMAIL]", "[NAME] [EMAIL]", "dear [NAME]")


def test_chat_without_a_side(spark):
    assert chat(spark, '"Customer: only me"', '"Agent: only I"', "no labels at all", None) == [
        ("only me", "only me", None, "Other", "low"),
        (None, None, "only I", "Other", "low"),
        ("no labels at all", "no labels at all", None, "Other", "low"),
    ]


def test_subject_is_the_first_sentence(spark):
    ((subject, body, *_),) = chat(spark, "Customer: " + "ab " * 100 + "end! More.")
    assert subject == "ab " * 100 + "end!" and body.endswith("More.")
    df = spark.createDataFrame([("Customer: " + "ab " * 100,)], schemas.CHATS)
    (row,) = normalize.normalize_chats(df, rules=normalize.Rules(subject_chars=80)).collect()
    assert len(row.subject) == 80 and len(row.body) == 299


def test_label_lines_of_other_channels_are_text(spark):
    ((_, body, *_),) = chat(spark, "Customer: I moved\nFrom: Berlin\nTo: Paris, please update\nAgent: done")
    assert body == "I moved\nFrom: Berlin\nTo: Paris, please update"


def mail(spark, cell):
    (row,) = rows(normalize.normalize_emails(spark.createDataFrame([(cell,)], "email string")).select("subject", "body", "answer"))
    return row


def test_every_turn_of_an_email_is_kept(spark):
    cell = "Subject: x\nCustomer: one. Best regards, Ann\nSupport: yes.\n-- \nThe team\nCustomer: two\nRegards,\nAnn Lee\nSupport: also this"
    assert mail(spark, cell.replace("one. Best", "one.\nBest")) == ("x", "one. two", "yes. also this")


def test_quoted_lines_go_one_by_one(spark):
    cell = "Subject: x\nCustomer: > old\n>> older\nthe real question\nOn Tuesday Bo wrote:\n> again\nand its end\nSupport: ok"
    assert mail(spark, cell) == ("x", "the real question\nand its end", "ok")


def test_a_closing_word_within_a_text_stays(spark):
    cell = "Subject: x\nCustomer: it worked\nThanks, but now the lamp is broken too\nSupport: see you\nThanks,\nBo"
    assert mail(spark, cell) == ("x", "it worked\nThanks, but now the lamp is broken too", "see you")


def test_disclaimers_and_forwarded_mail_go(spark):
    cell = "Subject: x\nplain words above\nCustomer: hello there\nThis e-mail and its files are confidential. Delete it.\nSupport: ok\n----- Original Message -----\nold"
    assert mail(spark, cell) == ("x", "plain words above hello there", "ok")


def test_email(spark):
    cell = (
        '"Subject: Invoice INV-55120 wrong\\nFrom: Ada <ada@x.org>\\nTo: Help <help@x.org>\\nCustomer: Dear Support, the invoice is wrong.'
        "\\nBest regards\\nAda Doe\\nSupport: Corrected. Call +1 (743) 555-3824.\\nOn Monday Ada wrote:\\n> the invoice"
        '"'
    )
    got = rows(normalize.normalize_emails(spark.createDataFrame([(cell,)], "email string")).select("source", *FIELDS))
    assert got == [
        ("email", "Invoice [INVOICE] wrong", "the invoice is wrong.", "Corrected. Call [NUMBER].", "Billing and Payments", "medium")
    ]


def test_call(spark):
    df = spark.createDataFrame([("Customer: no sound\nstill none\nAgent: restart it",)], schemas.TRANSCRIPTS)
    got = rows(normalize.normalize_calls(df).select("source", *FIELDS))
    assert got == [("call", "no sound\nstill none", "no sound\nstill none", "restart it", "Other", "low")]


def test_forms_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", "b", "c", None, ""), ("a", "b", "c", "", None), ("a", "b", "c", None, "")], schemas.FORMS)
    keys = [r.source_key for r in normalize.forms_passthrough(df).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_extractor(spark):
    def load():
        return lambda prompts: [
            {"subject": p[-3:], "body": "b", "answer": "a", "type": "Other", "priority": "low"} for p in prompts
        ]

    df = spark.createDataFrame([("one",), ("two",), (None,)], "chat string")
    got = rows(normalize.extract(df, "chat", "chat", normalize.model_extractor(Model(load))))
    assert [(r[0], r[2], r[5]) for r in got] == [("chat", "one", "Other"), ("chat", "two", "Other")]


def test_transcriber(spark, tmp_path):
    from ticketlens.sources.files import list_objects

    (tmp_path / "a.wav").write_bytes(b"spoken")
    speech = model_column(Model(lambda: lambda blobs: [bytes(b).decode() for b in blobs]), T.StringType())
    got = normalize.transcribe(list_objects(spark, str(tmp_path), "*.wav"), speech)
    assert "content" not in got.columns
    assert got.select("transcripts").head()[0] == "spoken"


# --- models and scoring ------------------------------------------------------


def upper_or_fail(texts):
    if "bad" in texts:
        raise ValueError("bad input")
    return [t.upper() for t in texts]


def test_a_dead_model_fails_the_job(spark):
    def dead(texts):
        raise OSError("no service")

    df = spark.range(1000).select(F.col("id").cast("string").alias("t")).coalesce(1)
    with pytest.raises(Exception, match="no service"):
        df.select(model_column(Model(lambda: dead), T.StringType())(F.col("t"))).collect()


def test_a_failing_row_gives_null_and_spares_the_others(spark):
    df = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "t string")
    column = model_column(Model(lambda: upper_or_fail), T.StringType())
    assert [r[0] for r in df.coalesce(1).select(column(F.col("t"))).collect()] == ["A", None, None, "C"]
    strict = model_column(Model(lambda: upper_or_fail, on_error="raise"), T.StringType())
    with pytest.raises(Exception, match="bad input"):
        df.select(strict(F.col("t"))).collect()


def test_scores_of_several_types(spark):
    df = spark.createDataFrame([("good",), ("awful",)], "t string")
    scorers = {
        "risk": model_column(Model(lambda: lambda texts: [len(t) / 10 for t in texts]), T.DoubleType()),
        "flag": model_column(Model(lambda: lambda texts: [t == "good" for t in texts]), T.BooleanType()),
        "mood": scoring.sentiment_scorer(),
    }
    got = rows(scoring.add_scores(df, "t", scorers).orderBy("t"))
    assert got == [("awful", 0.5, False, "Negative"), ("good", 0.4, True, "Positive")]


def test_failed_texts_are_scored_again(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none")], "id long, t string")
    text = F.col("t")
    first = {"mood": model_column(Model(lambda: lambda ts: upper_or_fail([t for t in ts if t != "none"]) + [None] * ts.count("none") if ts != ["none"] else [None]), T.StringType())}
    store = settle(scoring.missing_scores(df.coalesce(1), text, None, first, "v1"), "test-store")
    assert sorted((r.failed, r.mood or "") for r in store.collect()) == [(False, ""), (False, "GOOD"), (True, "")]
    assert rows(scoring.attach_scores(df, text, store, "v1").orderBy("id").select("mood")) == [("GOOD",), (None,), (None,)]
    again = scoring.missing_scores(df, text, store, {"mood": scoring.sentiment_scorer()}, "v1")
    assert rows(again.select("failed", "mood")) == [(False, "Negative")]
    both = store.unionByName(again)
    assert rows(scoring.attach_scores(df, text, both, "v1").orderBy("id").select("mood")) == [("GOOD",), ("Negative",), (None,)]


def test_a_hot_key_is_spread(spark):
    from ticketlens.operators.hot import left_join_hot

    df = spark.range(5000).select("id", F.when(F.col("id") % 5 < 2, "hot").when(F.col("id") % 5 == 2, None).otherwise(F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("3", 2), ("zzz", 9)], "k string, v int")
    joined = left_join_hot(df, small, "k", hot_rows=100)
    plain = df.join(small, "k", "left").select("id", "k", "v")
    assert sorted(rows(joined), key=str) == sorted(rows(plain), key=str)


def test_store_scores_each_text_once_and_only_new_ones(spark):
    scorers = {"mood": scoring.sentiment_scorer()}
    df = spark.createDataFrame([(1, "good"), (2, "good"), (3, "bad"), (4, None)], "id long, t string")
    store = settle(scoring.missing_scores(df.where("id <= 2"), F.col("t"), None, scorers, "v1"), "test-store")
    assert store.count() == 1
    more = scoring.missing_scores(df, F.col("t"), store, scorers, "v1", tasks=3)
    assert more.rdd.getNumPartitions() == 3
    assert sorted(r.mood for r in more.collect()) == ["Negative"]
    assert scoring.missing_scores(df, F.col("t"), store, scorers, "v2").count() == 2
    got = scoring.attach_scores(df, F.col("t"), store.unionByName(more), "v1")
    assert rows(got.orderBy("id").select("id", "mood")) == [(1, "Positive"), (2, "Positive"), (3, "Negative"), (4, None)]


# --- embedding ---------------------------------------------------------------


def test_hashed_words(spark):
    df = spark.createDataFrame([("One two TWO",), ("two one-two",), ("",), ("123 …",), (None,), ("three",)], "t string")
    got = [r[0] for r in df.coalesce(1).select(embedding.hashed_words(16)(F.col("t"))).collect()]
    assert got[0] == got[1]
    assert got[2] is None and got[3] is None and got[4] is None
    for vector in (got[0], got[5]):
        assert len(vector) == 16 and np.linalg.norm(vector) == pytest.approx(1.0)


def test_embed_missing_leaves_the_others_alone(spark):
    seen = model_column(Model(lambda: lambda texts: [[float(len(t))] for t in texts]), schemas.VECTOR)
    df = spark.createDataFrame([("abc", [7.0]), ("abcd", None)], "t string, v array<double>")
    assert rows(embedding.embed(df, F.col("t"), seen, "v", "missing")) == [("abc", [7.0]), ("abcd", [4.0])]
    assert rows(embedding.embed(df, F.col("t"), seen, "v")) == [("abc", [3.0]), ("abcd", [4.0])]
    assert rows(embedding.embed(df.drop("v"), F.col("t"), seen, "v", "missing")) == [("abc", [3.0]), ("abcd", [4.0])]
    with pytest.raises(ValueError):
        embedding.embed(df, F.col("t"), seen, "v", "some")


def test_tfidf_shares_one_space(spark):
    corpus = spark.createDataFrame([("red bag",), ("blue bag",), ("red shoe",), (None,)], "t string")
    again = embedding.fit_tfidf(corpus, "t", 64)
    got = [r.v for r in embedding.embed_tfidf(corpus, "t", again, "v").collect()]
    query = embedding.embed_tfidf(spark.createDataFrame([("blue bag",)], "t string"), "t", again, "v").head().v
    assert int(np.argmax([np.dot(query, v) for v in got[:3]])) == 1
    assert np.linalg.norm(got[0]) == pytest.approx(1.0) and len(got[0]) == 64


def test_texts_of_a_batch_are_split_in_slices_of_bounded_bytes(monkeypatch):
    """A batch of many long texts was split into all its words at once."""
    import pyarrow as pa

    from ticketlens.operators import embedding

    texts = pa.array(["aa bb cc"[: 2 + i % 6] * i if i % 7 else None for i in range(200)])
    whole = embedding._unit_rows(embedding._bucket_counts(texts, 8, {})).to_pylist()
    monkeypatch.setattr(embedding, "SLICE_BYTES", 500)
    parts = list(embedding.text_slices(texts))
    assert len(parts) > 20 and pa.concat_arrays(parts).equals(texts)
    assert all(sum(len(t or "") for t in part.to_pylist()[1:]) <= 500 for part in parts)
    assert [row for part in parts for row in embedding._unit_rows(embedding._bucket_counts(part, 8, {})).to_pylist()] == whole
    assert [len(part) for part in embedding.text_slices(texts[:0])] == [0]
