"""Every query against its SQL twin, on whole tables."""

import pytest

import __spark_entry__ as entry
from ticketlens.catalogue.queries import QUERIES as BASE
from tests.oracle_check import connect, difference

SF = "/root/testdata/sf0.01"
QUERIES = {name: query for name, query in entry.queries().items() if name in BASE}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in BASE}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(duck, QUERIES[name](spark, SF), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_gives_one_row(spark):
    assert entry.entry(spark).count() == 1


def test_every_class_of_every_rule_occurs(spark):
    """An oracle match on a class that never occurs would show nothing."""
    seen = {
        name: {row[0] for row in QUERIES[name](spark, SF).select(column).distinct().collect()}
        for name, column in [
            ("classify_type", "type"),
            ("classify_priority", "priority"),
            ("score_sentiment", "sentiment"),
            ("score_abuse", "abusive"),
            ("score_satisfaction", "satisfied"),
            ("answer_or_route", "routed"),
            ("churn_distribution", "bucket_label"),
        ]
    }
    assert len(seen["classify_type"]) == 6
    assert seen["classify_priority"] == {"high", "medium", "low"}
    assert seen["score_sentiment"] == {"Positive", "Neutral", "Negative"}
    assert len(seen["churn_distribution"]) >= 3
    for name in ("score_abuse", "score_satisfaction", "answer_or_route"):
        assert seen[name] == {True, False}, name
