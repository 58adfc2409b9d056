import pytest
from pyspark.sql import functions as F

from ticketlens.functions import classify, numbers, privacy, text


def values(spark, rows, schema, column):
    return [row[0] for row in spark.createDataFrame(rows, schema).select(column).collect()]


def test_ticket_text_ladder(spark):
    rows = [("s", "b"), ("s", None), (None, "b"), (None, None), ("", "")]
    assert values(spark, rows, "subject string, body string", text.ticket_text()) == ["s b", "s", "b", "", " "]


def test_filled_comments(spark):
    rows = [(None,), ([],), ([None],), (["  "],), ([" a ", "", "b"],), (["\t"],), (["\n x\r"],)]
    got = values(spark, rows, "c array<string>", text.filled_comments(F.col("c")))
    assert got == [None, [], [], [], ["a", "b"], [], ["x"]]


@pytest.mark.parametrize("length, cut", [(199, False), (200, False), (201, True)])
def test_preview(spark, length, cut):
    (got,) = values(spark, [("é" * length,)], "d string", text.preview(F.col("d")))
    assert got == ("é" * 200 + "…" if cut else "é" * length)


def test_public_url_only_at_the_start(spark):
    got = values(spark, [("gs://b/gs://x",), ("http://gs://",), (None,)], "u string", text.public_url(F.col("u")))
    assert got == ["https://storage.googleapis.com/b/gs://x", "http://gs://", None]


def test_with_slash():
    assert [text.with_slash(p) for p in ("", "gs://b", "gs://b/")] == ["", "gs://b/", "gs://b/"]


def test_words_and_counts(spark):
    rows = [("Bad, BAD-bad! badly abad bad1bad",), ("",), (None,)]
    found = text.words(F.col("t"))
    assert values(spark, rows, "t string", text.count_words(found, ["bad"])) == [5, 0, None]
    assert values(spark, rows, "t string", text.has_word(found, ["badly", "zzz"])) == [True, False, None]
    assert values(spark, rows, "t string", text.has_word(found, [])) == [False, False, False]


def test_clamp_keeps_null_and_nan_unscored(spark):
    rows = [(x,) for x in (-0.5, 0.0, 0.2, 1.0, 1.7, None, float("nan"))]
    assert values(spark, rows, "x double", numbers.unit_clamp(F.col("x"))) == [0.0, 0.0, 0.2, 1.0, 1.0, None, None]


def test_buckets(spark):
    rows = [(x,) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0, None)]
    labels = [label for _, label in numbers.RISK_BUCKETS] + [numbers.TOP_BUCKET]
    assert values(spark, rows, "x double", numbers.risk_bucket(F.col("x"))) == labels + [numbers.TOP_BUCKET] * 2
    assert values(spark, rows, "x double", numbers.risk_bucket(F.col("x"), "unscored"))[-1] == "unscored"
    with pytest.raises(ValueError):
        numbers.risk_bucket(F.col("x"), "bottom")


def test_percent_rounds_halves_to_even(spark):
    assert values(spark, [(0.1225,), (0.1235,), (None,)], "x double", numbers.percent(F.col("x"))) == [12.2, 12.4, None]


def test_number_or_zero(spark):
    rows = [(1.5,), (None,), (float("nan"),)]
    assert values(spark, rows, "x double", numbers.number_or_zero(F.col("x"))) == [1.5, 0.0, 0.0]


def test_redaction(spark):
    rows = [
        ("write to ada.b+c@mail.example.com now",),
        ("from 10.1.22.3, call +1 (743) 555-3824 or 4111111111111111",),
        ("Order K553311 and INV-55120-R1.",),
        ("ABC1234567 stays, 10.2.3.4.5 is no address, DE44500105175407324931 goes, so does W-70493 and X-81200.",),
        ("Ask Mr. Turner or Dr Ana Lee; Mrs. is alone.",),
        ("nothing here, only 12 items",),
        (None,),
    ]
    assert values(spark, rows, "t string", privacy.redact(F.col("t"))) == [
        "write to [EMAIL] now",
        "from [IP], call [NUMBER] or [NUMBER]",
        "Order [ORDER] and [INVOICE].",
        "ABC1234567 stays, [NUMBER] is no address, [ACCOUNT] goes, so does [CASE] and [CASE].",
        "Ask Mr. [NAME] or Dr [NAME]; Mrs. is alone.",
        "nothing here, only 12 items",
        None,
    ]


def test_redaction_by_signs_is_that_of_all_patterns(spark):
    parts = ["10.1.22.3", "1.2.3", "INV-5512-R1", "INV-12", "W-70493", "W-12", "K553311", "AB12 3456 7890", "AB12", "+1 (743) 555-3824", "555 38", "x@y.org", "12", "é"]
    rows = [(f"{a}{gap}{b}",) for a in parts for b in parts for gap in ("", " ", ".", ", ")]
    t = F.col("t")
    plain = privacy._replaced(privacy._replaced(t, privacy.ADDRESS_PATTERNS), privacy.NUMBER_PATTERNS)
    assert values(spark, rows, "t string", privacy.redact(t)) == values(spark, rows, "t string", plain)
    # Labels that could make a match of their own are not judged by signs.
    odd = privacy.redact(t, addresses=((r"@+", ""),))
    assert values(spark, [("W-70@@493",)], "t string", odd) == ["[CASE]"]


def test_first_matching_rule_wins(spark):
    rows = [("The invoice shows an error",), ("an error on install",), ("hello",), (None,)]
    got = values(spark, rows, "t string", classify.ticket_type(text.words(F.col("t"))))
    assert got == ["Billing and Payments", "Technical Support", "Other", "Other"]


def test_urgent_ignores_case(spark):
    rows = [("High",), ("URGENT",), ("p1",), ("critical",), ("medium",), (None,), ("unknown",), (" high",)]
    got = values(spark, rows, "p string", classify.is_urgent(F.col("p")))
    assert got == [True] * 4 + [False] * 4
