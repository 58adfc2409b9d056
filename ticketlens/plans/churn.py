"""Churn risk and sentiment from learned words instead of fixed lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ticket_text
from ..operators.weights import add_word_total, calibrated, cue_weights, fit_monotone, induced_polarity, word_density
from ..session import settle


@dataclass(frozen=True)
class ChurnModel:
    """The cue words with their weights, and the risk by density of them."""

    cues: DataFrame
    shares: Sequence[float]
    width: float


def fit_churn(df: DataFrame, text: Column, left: Column, least_z: float = 1.96, prior: float = 1000.0, width: float = 0.05, bins: int = 64) -> ChurnModel:
    """Cues are the words that the texts of those who ``left`` have more often, at ``least_z`` standard deviations or more.

    A text's density is the sum of its cues' weights over its number of words, and its risk the share of those who left among texts of such a
    density, made never to fall as the density grows. Eager.
    """
    cues = settle(cue_weights(df, text, left, prior).where(F.col("z") >= least_z).select("word", "weight"), "churn-cues")
    dense = word_density(df.select(text.alias("text"), left.cast("int").alias("left")), F.col("text"), cues, "density")
    return ChurnModel(cues, fit_monotone(dense, F.col("density"), F.col("left"), width, bins), width)


def score_churn_weighted(tickets: DataFrame, model: ChurnModel, out: str = "churn") -> DataFrame:
    """``tickets`` with their risk from 0 to 1; NULL for a ticket without a word."""
    dense = word_density(tickets, ticket_text(), model.cues, "_density")
    return dense.withColumn(out, calibrated(F.col("_density"), model.shares, model.width)).drop("_density")


def learn_polarity(df: DataFrame, text: Column, positive: Sequence[str], negative: Sequence[str], window: int = 4, least_pairs: int = 40) -> DataFrame:
    """(word, weight) of the words with a polarity that have ``least_pairs`` neighbours or more, the seeds with a weight of 1 at least. Eager."""
    found = induced_polarity(df, text, positive, negative, window).where((F.col("n") >= least_pairs) & (F.col("weight") != 0)).select("word", "weight")
    spark = df.sparkSession
    seeds = spark.createDataFrame([(w, 1.0) for w in positive if w not in negative] + [(w, -1.0) for w in negative if w not in positive], "word string, seed double")
    both = found.join(seeds, "word", "full")
    sure = F.when(F.col("seed") > 0, F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1.0))).when(F.col("seed") < 0, F.least(F.coalesce("weight", F.lit(-1.0)), F.lit(-1.0)))
    return settle(both.select("word", F.coalesce(sure, "weight").alias("weight")), "polarity")


def score_sentiment_induced(tickets: DataFrame, polarity: DataFrame, margin: float = 0.0, out: str = "sentiment") -> DataFrame:
    """Positive, Neutral or Negative by the sum of the polarity of a ticket's words, beyond ``margin`` either way."""
    dense = add_word_total(tickets, ticket_text(), polarity, "_total")
    total = F.round("_total", 9)
    mood = F.when(total > margin, "Positive").when(total < -margin, "Negative").otherwise("Neutral")
    return dense.withColumn(out, mood).drop("_total")
