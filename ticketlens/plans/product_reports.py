"""Product reports from customer comments: moderation and satisfaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import share, sum_where
from ..functions.text import filled_comments, first_chars
from ..operators.models import ColumnFunction
from ..operators.scoring import abuse_scorer, add_scores, satisfaction_scorer


def commented_products(products: DataFrame, comments_col: str = "customer_comments") -> DataFrame:
    """product_id, comments, comments_text of the products with a non-blank comment."""
    return (
        products.select("product_id", filled_comments(F.col(comments_col)).alias("comments"))
        .where(F.size("comments") > 0)
        .withColumn("comments_text", F.array_join("comments", "\n"))
    )


def score_products(
    products: DataFrame,
    abuse: ColumnFunction | None = None,
    satisfaction: ColumnFunction | None = None,
    snippet_chars: int = 300,
) -> DataFrame:
    """The table the reports read: the commented products with ``abusive``,
    ``satisfied`` and the start of their comments."""
    scorers = {"abusive": abuse or abuse_scorer(), "satisfied": satisfaction or satisfaction_scorer()}
    scored = add_scores(commented_products(products), "comments_text", scorers)
    snippet = first_chars(F.array_join("comments", " | "), snippet_chars)
    return scored.select("product_id", *scorers, snippet.alias("comment_snippet"))


def _rate(scored: DataFrame, flag: str, hits: str, total: str, rate: str) -> DataFrame:
    count = scored.agg(sum_where(F.col(flag)).alias(hits), F.count(F.lit(1)).alias(total))
    return count.withColumn(rate, share(F.col(hits), F.col(total)))


def _by_flag(scored: DataFrame, flag: str) -> DataFrame:
    return scored.groupBy(flag).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), flag)


def abuse_kpis(scored: DataFrame) -> DataFrame:
    return _rate(scored, "abusive", "abusive_count", "total_with_comments", "abuse_rate")


def abuse_distribution(scored: DataFrame) -> DataFrame:
    return _by_flag(scored, "abusive")


def abusive_examples(scored: DataFrame, limit: int = 20) -> DataFrame:
    """product_id, comment_snippet, abusive of flagged products, by product id."""
    flagged = scored.where(F.col("abusive")).select("product_id", "comment_snippet", "abusive")
    return flagged.orderBy("product_id").limit(limit)


def satisfaction_kpis(scored: DataFrame) -> DataFrame:
    return _rate(scored, "satisfied", "satisfied_count", "total_scored", "satisfaction_rate")


def satisfaction_distribution(scored: DataFrame) -> DataFrame:
    return _by_flag(scored, "satisfied")


def with_label(distribution: DataFrame, flag: str, yes: str, no: str) -> DataFrame:
    """A boolean distribution with words for a chart; NULL stays NULL."""
    return distribution.withColumn("label", F.when(F.col(flag), yes).when(~F.col(flag), no))
