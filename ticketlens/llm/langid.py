"""Language identification, words first, with a fall back to character n-grams.

A known word scores by its logarithmic frequency in each language. An unseen word
scores by the mean logarithmic frequency of its character n-grams of the greatest
length of which any is known, down to single letters; a word with no known letter
says nothing. Words are runs of letters, in lower case; n-grams take in the
space on either side of a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import HashTable, broadcast_value, sampled_by_class
from .words import Words, char_grams, pieces, signed, split, texts_of

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class LanguageModel:
    """What was learned: the languages, and a table for whole words (level 0) and each n-gram length."""

    languages: list[str]
    levels: dict[int, HashTable]  # values: one logarithmic frequency per language


def _clean(text: bytes | None) -> bytes | None:
    """The text's letters in lower case, words a space apart; None if it has none."""
    if not text:
        return None
    kept = _NOT_LETTERS.sub(" ", text.decode().lower())
    return kept.encode() if any(map(str.isalpha, kept)) else None


def _counted(languages: list[str], longest: int):
    """Counts of words and n-grams by language, summed over each batch."""
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_clean(t) for t in texts_of(batch, "text")]
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in pieces(texts):
                words = split(texts, lo, hi)
                lang = langs[lo:hi][words.text_of()]
                for level in range(longest + 1):
                    owner, hashes = char_grams(words, level) if level else (np.arange(len(lang)), words.hash)
                    for k in range(len(languages)):
                        keys, n = np.unique(hashes[lang[owner] == k], return_counts=True)
                        if len(keys):
                            full = [pa.array(np.full(len(keys), x, np.int64)) for x in (level, k)]
                            yield pa.RecordBatch.from_arrays([*full, pa.array(signed(keys)), pa.array(n)], ["level", "lang", "key", "n"])

    return count


def fit_languages(
    examples: DataFrame, per_language: int = 2000, longest: int = 4, max_entries: int = 40_000, min_count: int = 2, smoothing: float = 0.5
) -> LanguageModel:
    """Learn from (text, lang) rows; rows with a null in either teach nothing.

    About ``per_language`` rows of each language are used, drawn at random with a
    fixed seed. Of the words, and of the n-grams of each length, the
    ``max_entries`` most frequent of at least ``min_count`` occurrences are kept
    (n-grams: the same). These are the bounds on what reaches the driver. Without
    usable rows the model knows no language. Eager.
    """
    rows = examples.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    sample, languages = sampled_by_class(rows, "lang", per_language)
    if not languages:
        return LanguageModel([], {})
    counts = sample.mapInArrow(_counted(languages, longest), "level long, lang long, key long, n long")
    by_language = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(languages))]
    table = counts.groupBy("level", "key").agg(F.sum("n").alias("n"), *by_language).where(F.col("n") >= min_count).persist()
    levels = {}
    for level in range(longest + 1):
        top = table.where(F.col("level") == level).orderBy(F.desc("n"), "key").limit(max_entries).toArrow()
        seen = np.stack([top.column(f"n{k}").to_numpy() for k in range(len(languages))], 1).astype(float)
        logs = np.log((seen + smoothing) / (seen.sum(0) + smoothing * (len(top) + 1)))
        levels[level] = HashTable.of(top.column("key").to_numpy().view(np.uint64), logs.astype(np.float32))
    table.unpersist()
    return LanguageModel(languages, levels)


def _scores(words: Words, model: LanguageModel) -> np.ndarray:
    """Sum over each text's words of the logarithmic frequency per language."""
    values = np.zeros((len(words.hash), len(model.languages)))
    at, known = model.levels[0].find(words.hash)
    values[known] = model.levels[0].values[at[known]]
    left = ~known
    for n in sorted((n for n in model.levels if n), reverse=True):
        if not left.any():
            break
        owner, hashes = char_grams(words, n, left)
        at, found = model.levels[n].find(hashes)
        owner, at = owner[found], at[found]
        number = np.bincount(owner, minlength=len(left))
        hit = number > 0
        for k in range(values.shape[1]):
            total = np.bincount(owner, model.levels[n].values[at, k], minlength=len(left))
            values[hit, k] = total[hit] / number[hit]
        left &= ~hit
    running = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0)])
    return running[words.first[1:]] - running[words.first[:-1]]


def _shares(texts: list[bytes | None], model: LanguageModel) -> np.ndarray:
    """Per cleaned text each language's share of the likelihood, flattened by the square root of its words."""
    out = np.zeros((len(texts), len(model.languages)))
    for lo, hi in pieces(texts) if model.languages else ():
        words = split(texts, lo, hi)
        total = _scores(words, model) / np.sqrt(np.maximum(words.counts, 1))[:, None]
        share = np.exp(total - total.max(1, keepdims=True))
        out[lo:hi] = share / share.sum(1, keepdims=True)
    return out


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), has_letters.

    ``und`` with score 0 for a null text, one without a letter, or where the model
    knows no language. The score is the language's share of the texts' likelihoods,
    flattened by the square root of the number of words, as words are not independent.
    Equal languages: the first by name. Texts are read whole.
    """
    sent = broadcast_value(docs.sparkSession, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [_clean(t) for t in texts_of(batch, "text")]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            share = _shares(texts, model)
            if model.languages:
                for i, k in enumerate(share.argmax(1).tolist()):
                    if texts[i]:
                        best[i], score[i] = model.languages[k], share[i, k]
            found = pa.array([t is not None for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score), found], ["doc_id", "lang_pred", "score", "has_letters"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, has_letters boolean")


def identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.5) -> DataFrame:
    """The documents whose language is told with ``least_score`` or more, all columns as they are.

    Documents without a letter go. A model that knows no language rejects only those.
    """
    sent = broadcast_value(docs.sparkSession, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_clean(t) for t in texts_of(batch, "text")]
            score = _shares(texts, sent.value).max(1, initial=0)
            letters = np.array([t is not None for t in texts], bool)
            yield batch.filter(pa.array(letters & ((score >= least_score) | (not sent.value.languages))))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))


def labelled(docs: DataFrame, model: LanguageModel, column: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The documents with a letter, all columns as they are, but ``column`` names the language that their text is told to be in.

    A language is told where its score is above ``least_score``, and there are others to tell it from. Elsewhere, such as in a script that no
    learned language has, ``column`` stays as it is; no document goes for that.
    """
    sent = broadcast_value(docs.sparkSession, model)
    place = docs.columns.index(column)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = sent.value.languages
        for batch in batches:
            texts = [_clean(t) for t in texts_of(batch, "text")]
            share = _shares(texts, sent.value)
            told = share.max(1, initial=0) > (least_score if len(languages) > 1 else 1)
            best = share.argmax(1).tolist() if languages else []
            stated = batch.column(place).cast(pa.string()).to_pylist()
            found = [languages[best[i]] if told[i] else old for i, old in enumerate(stated)]
            columns = batch.columns
            columns[place] = pa.array(found, pa.string()).cast(columns[place].type)
            letters = pa.array([t is not None for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(letters)

    return docs.mapInArrow(label, T.StructType(docs.schema.fields))
