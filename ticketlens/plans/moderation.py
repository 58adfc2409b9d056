"""A learned alternative to the abuse lexicon: naive Bayes on word counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.weights import add_word_total, counted_words
from ..session import settle


@dataclass(frozen=True)
class AbuseModel:
    """Words with what each adds to the logarithm of the odds, and the odds of a text without any."""

    weights: DataFrame
    prior: float


def train_abuse_model(labelled: DataFrame, text_col: str, label_col: str) -> AbuseModel:
    """Multinomial naive Bayes, one added to each count. Rows without a label or text teach nothing.

    The words stay in a table of their own, however many there are. Eager: it is written.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    label = F.col(label_col).cast("int")
    rows = known.agg(F.sum(label).alias("bad"), F.count("*").alias("n")).head()
    bad, good = rows["bad"] or 0, rows["n"] - (rows["bad"] or 0)
    each = known.select(label.alias("label"), F.explode(counted_words(F.col(text_col))).alias("word"))
    counts = each.groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    counts = settle(counts, "abuse-words")
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).head()
    size = total["words"]
    share = [F.log((F.col(side) + 1) / F.lit(float((total[side] or 0) + size))) for side in ("bad", "good")]
    prior = math.log((bad + 1) / (good + 1))
    return AbuseModel(counts.select("word", (share[0] - share[1]).alias("weight")), prior)


def flag_abuse(df: DataFrame, id_col: str, text_col: str, model: AbuseModel, out: str = "abusive") -> DataFrame:
    """``df`` with whether its words make abuse likelier than not; unknown words say nothing.

    Rows are judged one by one, also those that repeat a value of ``id_col``.
    """
    scored = add_word_total(df, F.col(text_col), model.weights, "_total")
    return scored.withColumn(out, F.round(F.col("_total") + F.lit(model.prior), 6) > 0).drop("_total")
