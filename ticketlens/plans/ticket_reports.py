"""Ticket reports.

Each is a plain aggregate over stored columns: ``sentiment`` and ``churn`` are
scored once (see ``operators.scoring``), never inside a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_urgent
from ..functions.numbers import count_where, number_or_zero, percent, risk_bucket, share, sum_where, unit_clamp
from ..functions.text import first_chars, ticket_text
from ..operators.models import ColumnFunction
from ..operators.scoring import add_scores, churn_scorer, sentiment_scorer


def score_tickets(
    tickets: DataFrame,
    sentiment: ColumnFunction | None = None,
    churn: ColumnFunction | None = None,
    snippet_chars: int = 200,
) -> DataFrame:
    """The table the reports read: ``tickets`` with ``sentiment``, ``churn``
    (unclamped) and a ``snippet`` in place of the long texts and the vector, so
    that no report reads those."""
    scorers = {"sentiment": sentiment or sentiment_scorer(), "churn": churn or churn_scorer()}
    scored = add_scores(tickets.withColumn("_text", ticket_text()), "_text", scorers)
    snippet = first_chars(F.col("_text"), snippet_chars)
    return scored.withColumn("snippet", snippet).drop("_text", "subject", "body", "answer", "text_embedding")


def _or_unknown(name: str):
    return F.coalesce(F.col(name), F.lit("unknown"))


def ticket_kpis(scored: DataFrame) -> DataFrame:
    """total_tickets, negative_rate, urgent_count. Case does not matter, spaces do."""
    negative = count_where(F.lower(_or_unknown("sentiment")) == "negative")
    total = F.count(F.lit(1))
    return scored.agg(
        total.alias("total_tickets"),
        share(negative, total).alias("negative_rate"),
        count_where(is_urgent(F.col("priority"))).alias("urgent_count"),
    )


def kpis_for_display(kpis: DataFrame) -> DataFrame:
    """The one-row KPIs with NULL and NaN shown as zero."""
    return kpis.select(
        F.coalesce("total_tickets", F.lit(0)).alias("total_tickets"),
        number_or_zero(F.col("negative_rate")).alias("negative_rate"),
        F.coalesce("urgent_count", F.lit(0)).alias("urgent_count"),
    )


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """sentiment, cnt. Labels differing in case are different labels."""
    return _counts(scored, _or_unknown("sentiment"), "sentiment")


def priority_distribution(tickets: DataFrame) -> DataFrame:
    """priority, cnt, pct. The total is taken over the counted groups, one row
    per label, so the table is read once."""
    counts = tickets.groupBy(_or_unknown("priority").alias("priority")).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())
    return counts.withColumn("pct", share(F.col("cnt"), total)).orderBy(F.desc("cnt"), "priority")


def top_types(tickets: DataFrame, limit: int = 5) -> DataFrame:
    """type, cnt of the most frequent types."""
    return _counts(tickets, _or_unknown("type"), "type").limit(limit)


def _counts(df: DataFrame, key, name: str) -> DataFrame:
    # Grouped by the expression: NULL and a literal 'unknown' are one group.
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), name)


def churn_kpis(scored: DataFrame, high_threshold: float = 0.7, accuracy: int = 10_000) -> DataFrame:
    """avg_risk, p90_risk, high_risk_count, total_tickets in one pass.

    Unscored tickets count in the total only.
    """
    risk = unit_clamp(F.col("churn"))
    return scored.select(risk.alias("risk")).agg(
        F.avg("risk").alias("avg_risk"),
        F.percentile_approx("risk", 0.9, accuracy).alias("p90_risk"),
        sum_where(F.col("risk") >= high_threshold).alias("high_risk_count"),
        F.count(F.lit(1)).alias("total_tickets"),
    )


def churn_distribution(scored: DataFrame, null_bucket: str = "top") -> DataFrame:
    """bucket_label, cnt; buckets without tickets are absent."""
    label = risk_bucket(unit_clamp(F.col("churn")), null_bucket)
    return scored.groupBy(label.alias("bucket_label")).agg(F.count(F.lit(1)).alias("cnt")).orderBy("bucket_label")


def riskiest_tickets(scored: DataFrame, limit: int = 20) -> DataFrame:
    """ticket_id, risk, risk_pct, snippet of the tickets most at risk, unscored last."""
    risk = unit_clamp(F.col("churn")).alias("risk")
    top = scored.select("ticket_id", risk, "snippet").orderBy(F.desc_nulls_last("risk"), "ticket_id").limit(limit)
    return top.select("ticket_id", "risk", percent(F.col("risk")).alias("risk_pct"), "snippet")
