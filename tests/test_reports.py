"""Report semantics on hand-built rows: NULLs, ties, labels and empty input."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import prompts
from ticketlens.operators.models import Model, model_column
from ticketlens.operators.scoring import prompted
from ticketlens.plans import product_reports as products
from ticketlens.plans import ticket_reports as tickets
from ticketlens.session import settle

SCORED = "ticket_id long, snippet string, sentiment string, priority string, type string, churn double"


def scored(spark, rows):
    return spark.createDataFrame(rows, SCORED)


@pytest.fixture
def some(spark):
    return scored(
        spark,
        [
            (1, "a", "Positive", "High", "x", 0.9),
            (2, "b", "negative", "URGENT", "x", 0.9),
            (3, "c", "Negative", "p1", None, 0.1),
            (4, "d", "Negative.", "medium", "unknown", 1.7),
            (5, "e", None, None, "y", None),
            (6, "f", "unknown", "unknown", "z", float("nan")),
        ],
    )


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_ticket_kpis(some):
    # Lower-cased but not trimmed: 'Negative.' is no negative.
    assert rows(tickets.ticket_kpis(some)) == [(6, pytest.approx(2 / 6), 3)]


def test_sentiment_keeps_case_and_merges_unknown(some):
    assert rows(tickets.sentiment_distribution(some)) == [
        ("unknown", 2), ("Negative", 1), ("Negative.", 1), ("Positive", 1), ("negative", 1),
    ]


def test_priority_distribution(some):
    got = rows(tickets.priority_distribution(some))
    assert got[0] == ("unknown", 2, pytest.approx(2 / 6))
    assert [row[0] for row in got[1:]] == ["High", "URGENT", "medium", "p1"]
    assert sum(row[2] for row in got) == pytest.approx(1.0)


def test_top_types_cuts_ties_by_name(spark):
    df = scored(spark, [(i, "", None, None, kind, None) for i, kind in enumerate("fedcbaa")])
    assert rows(tickets.top_types(df)) == [("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1)]


def test_churn_kpis(some):
    avg_risk, p90, high, total = rows(tickets.churn_kpis(some))[0]
    assert avg_risk == pytest.approx((0.9 + 0.9 + 0.1 + 1.0) / 4)
    assert (p90, high, total) == (1.0, 3, 6)


def test_churn_distribution_puts_unscored_on_top(some):
    assert rows(tickets.churn_distribution(some)) == [("[0.0–0.2)", 1), ("[0.8–1.0]", 5)]
    assert ("unscored", 2) in rows(tickets.churn_distribution(some, "unscored"))


def test_riskiest(some):
    got = rows(tickets.riskiest_tickets(some, limit=5))
    assert [row[0] for row in got] == [4, 1, 2, 3, 5]
    assert got[0][1:] == (1.0, 100.0, "d")


def test_empty_input(spark):
    none = scored(spark, [])
    assert rows(tickets.ticket_kpis(none)) == [(0, None, 0)]
    assert rows(tickets.kpis_for_display(tickets.ticket_kpis(none))) == [(0, 0.0, 0)]
    assert rows(tickets.churn_kpis(none)) == [(None, None, None, 0)]
    for report in (tickets.sentiment_distribution, tickets.priority_distribution, tickets.top_types, tickets.churn_distribution, tickets.riskiest_tickets):
        assert rows(report(none)) == []
    commented = spark.createDataFrame([], "product_id string, comment_snippet string, abusive boolean, satisfied boolean")
    assert rows(products.abuse_kpis(commented)) == [(None, 0, None)]
    assert rows(products.satisfaction_kpis(commented)) == [(None, 0, None)]
    assert rows(products.abuse_distribution(commented)) == []
    assert rows(products.abusive_examples(commented)) == []


@pytest.fixture
def commented(spark):
    return spark.createDataFrame(
        [
            ("P10", "a", True, False),
            ("P2", "b", True, None),
            ("P1", "c", False, True),
            ("P3", "d", None, True),
        ],
        "product_id string, comment_snippet string, abusive boolean, satisfied boolean",
    )


def test_abuse_reports(commented):
    assert rows(products.abuse_kpis(commented)) == [(2, 4, 0.5)]
    assert rows(products.abuse_distribution(commented)) == [(True, 2), (None, 1), (False, 1)]
    assert rows(products.abusive_examples(commented)) == [("P10", "a", True), ("P2", "b", True)]
    assert rows(products.abusive_examples(commented, limit=1)) == [("P10", "a", True)]


def test_satisfaction_reports(commented):
    assert rows(products.satisfaction_kpis(commented)) == [(2, 4, 0.5)]
    labelled = products.with_label(products.satisfaction_distribution(commented), "satisfied", "Satisfied", "Not satisfied")
    assert {row[2] for row in rows(labelled)} == {"Satisfied", "Not satisfied", None}


def test_only_commented_products_are_scored(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", []), ("c", [" ", None]), ("d", ["You idiot ", ""]), ("e", ["great", "bad", "great"])],
        "product_id string, customer_comments array<string>",
    )
    assert rows(products.score_products(df)) == [("d", True, False, "You idiot"), ("e", False, True, "great | bad | great")]
    assert rows(products.commented_products(df).select("comments_text")) == [("You idiot",), ("great\nbad\ngreat",)]
    (cut,) = rows(products.score_products(df.where("product_id = 'e'"), snippet_chars=7))
    assert cut[3] == "great |"


def test_default_ticket_scorers(spark):
    df = spark.createDataFrame([(1, "Terrible", "awful and late, thanks"), (2, "", " "), (3, None, "great")], "ticket_id long, subject string, body string")
    got = rows(tickets.score_tickets(df).select("sentiment", F.round("churn", 6), "snippet"))
    assert got == [("Negative", 0.6, "Terrible awful and late, thanks"), ("Neutral", None, "  "), ("Positive", 0.0, "great")]


def test_scored_tickets_are_narrow(spark):
    df = spark.createDataFrame([(1, "s" * 150, "b" * 150, "a", [1.0])], "ticket_id long, subject string, body string, answer string, text_embedding array<double>")
    (row,) = tickets.score_tickets(df).collect()
    assert row.asDict() == {"ticket_id": 1, "sentiment": "Neutral", "churn": 0.0, "snippet": "s" * 150 + " " + "b" * 49}


def test_reports_from_prompted_models(spark):
    """Injected models end to end: each text is sent once, after its instruction; a failure is an unscored row."""

    def mood(asked):
        assert all(prompt.startswith(prompts.SENTIMENT) for prompt in asked)
        return ["Negative" if "late" in prompt else "Positive" for prompt in asked]

    def risk(asked):
        if any("odd" in prompt for prompt in asked):
            raise ValueError("no number")
        return [float(prompt.removeprefix(prompts.CHURN).split()[0]) for prompt in asked]

    df = spark.createDataFrame([(1, "0.9", "late", "high"), (2, "1.8", "fine", None), (3, "odd", "late", "low")], "ticket_id long, subject string, body string, priority string")
    scored = settle(
        tickets.score_tickets(
            df,
            prompted(model_column(Model(lambda: mood), T.StringType()), prompts.SENTIMENT),
            prompted(model_column(Model(lambda: risk), T.DoubleType()), prompts.CHURN),
        ),
        "scored",
    )
    assert rows(tickets.ticket_kpis(scored)) == [(3, pytest.approx(2 / 3), 1)]
    assert rows(tickets.churn_kpis(scored)) == [(pytest.approx(0.95), 1.0, 2, 3)]
    assert [r[0] for r in rows(tickets.riskiest_tickets(scored))] == [2, 1, 3]

    flag = model_column(Model(lambda: lambda asked: ["rude" in prompt for prompt in asked]), T.BooleanType())
    items = spark.createDataFrame([("P1", ["so rude"]), ("P2", ["nice", " "])], "product_id string, customer_comments array<string>")
    flagged = products.score_products(items, prompted(flag, prompts.ABUSE), prompted(flag, prompts.SATISFACTION))
    assert rows(products.abuse_kpis(flagged)) == [(1, 2, 0.5)]
    assert rows(products.abusive_examples(flagged)) == [("P1", "so rude", True)]
