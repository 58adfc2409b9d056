"""Scoring: lexicon scorers, score columns, and a store of scores by text.

The lexicons are parameters. The defaults make every report runnable without a
model; they are no substitute for one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import scoring_prompt
from ..functions.text import count_words, has_word, strip_blanks, words
from .hot import left_join_hot
from .models import ColumnFunction, ModelColumn

NEGATIVE_WORDS = ("angry", "awful", "bad", "broken", "defective", "disappointed", "late", "poor", "refund", "terrible", "unacceptable", "worst", "wrong")
POSITIVE_WORDS = ("amazing", "excellent", "fast", "good", "great", "happy", "love", "perfect", "thank", "thanks", "works")
ABUSIVE_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")


@dataclass(frozen=True)
class WordScorer:
    """A scorer of a text's words. Called with a text it splits that itself;
    :func:`add_scores` splits a text once for all its word scorers."""

    of: Callable[[Column, Column], Column]

    def __call__(self, text: Column) -> Column:
        return self.of(words(text), text)


def sentiment_scorer(negative: Sequence[str] = NEGATIVE_WORDS, positive: Sequence[str] = POSITIVE_WORDS) -> WordScorer:
    """Positive, Neutral or Negative by which lexicon is hit more often."""

    def score(words: Column, _text: Column) -> Column:
        bad, good = count_words(words, negative), count_words(words, positive)
        return F.when(bad > good, "Negative").when(good > bad, "Positive").otherwise("Neutral")

    return WordScorer(score)


def churn_scorer(cues: Sequence[str] = NEGATIVE_WORDS, weight: float = 0.2) -> WordScorer:
    """``weight`` per cue word, at most 1; NULL for a blank text."""

    def score(words: Column, text: Column) -> Column:
        risk = F.least(F.lit(1.0), F.lit(weight) * count_words(words, cues))
        return F.when(strip_blanks(text) != "", risk)

    return WordScorer(score)


def abuse_scorer(lexicon: Sequence[str] = ABUSIVE_WORDS) -> WordScorer:
    return WordScorer(lambda words, _text: has_word(words, lexicon))


def satisfaction_scorer(negative: Sequence[str] = NEGATIVE_WORDS, positive: Sequence[str] = POSITIVE_WORDS) -> WordScorer:
    """True if a positive word occurs and at least as often as negative ones."""

    def score(words: Column, _text: Column) -> Column:
        good = count_words(words, positive)
        return (good >= count_words(words, negative)) & (good > 0)

    return WordScorer(score)


def prompted(model: ColumnFunction, instruction: str) -> ColumnFunction:
    """A model scorer that is sent ``instruction`` (see ``functions.prompts``) before each text."""
    if isinstance(model, ModelColumn):
        return replace(model, prepare=lambda text: model.prepare(scoring_prompt(instruction, text)))
    return lambda text: model(scoring_prompt(instruction, text))


def add_scores(df: DataFrame, text_col: str, scorers: Mapping[str, ColumnFunction]) -> DataFrame:
    """``df`` plus one column per scorer. Row-local: no join and no shuffle."""
    text = F.col(text_col)
    if any(isinstance(scorer, WordScorer) for scorer in scorers.values()):
        df = df.withColumn("_words", words(text))
    scores = {
        name: scorer.of(F.col("_words"), text) if isinstance(scorer, WordScorer) else scorer(text)
        for name, scorer in scorers.items()
    }
    return df.withColumns(scores).drop("_words")


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def missing_scores(
    df: DataFrame,
    text: Column,
    store: DataFrame | None,
    scorers: Mapping[str, ColumnFunction],
    version: str,
    tasks: int | None = None,
) -> DataFrame:
    """Score rows to append to ``store``: (text_key, model_version, failed, one column per scorer).

    Every distinct text is scored once, however many rows carry a copy of it,
    and a text the store already has for this ``version`` not at all, unless a model
    failed on it: such a row is marked ``failed``, and its text is scored again. For a
    slow model give ``tasks``: adaptive execution sizes tasks by bytes, and few
    bytes can be long work.
    """
    texts = df.where(text.isNotNull()).select(text_key(text).alias("text_key"), text.alias("_text"))
    if store is not None:
        known = _scored(store, version).select("text_key")
        texts = texts.join(known, "text_key", "left_anti")
    distinct = texts.groupBy("text_key").agg(F.first("_text").alias("_text"))
    if tasks:
        distinct = distinct.repartition(tasks)
    checked = {name: scorer.checked if isinstance(scorer, ModelColumn) else scorer for name, scorer in scorers.items()}
    scored = add_scores(distinct, "_text", checked)
    models = [name for name, scorer in scorers.items() if isinstance(scorer, ModelColumn)]
    failed = reduce(Column.__or__, [F.col(name)["failed"] for name in models], F.lit(False))
    values = [F.col(name)["value"].alias(name) if name in models else F.col(name) for name in scorers]
    return scored.select("text_key", F.lit(version).alias("model_version"), failed.alias("failed"), *values)


def _scored(store: DataFrame, version: str) -> DataFrame:
    return store.where((F.col("model_version") == version) & ~F.col("failed"))


def attach_scores(df: DataFrame, text: Column, store: DataFrame, version: str) -> DataFrame:
    """``df`` with its stored scores; NULL where there are none yet, or a model failed.

    The store has one row per text and version without a failure, so this is an equi-join that
    cannot multiply rows. A text that very many rows share makes no large group (``left_join_hot``).
    """
    scores = _scored(store, version).drop("model_version", "failed")
    return left_join_hot(df.withColumn("text_key", text_key(text)), scores, "text_key").drop("text_key")
