"""Words with learned weights: the sum over a text, weights of cues, induced polarity, and monotone calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_LETTERS, words
from ..session import settle
from .embedding import text_slices

#: Most weighted words that are sent to every task; a larger table is joined.
BROADCAST_WORDS = 200_000


def counted_words(text: Column) -> Column:
    """The text's words without empty ones, as an array; empty for NULL."""
    return F.filter(words(F.coalesce(text, F.lit(""))), lambda w: w != "")


def add_word_total(df: DataFrame, text: Column, weights: DataFrame, out: str, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``df`` with the sum of its words' weights in ``out``, repeats counted; 0.0 where no word is known.

    ``weights`` has distinct ``word`` values and ``weight``. Up to ``broadcast_words`` of them go to every task, which adds up inside the
    row: nothing is shuffled. Of a larger table the words that a sample of the rows has most often do so; what is left of a row is counted
    inside it and joined by word. Which words are sent does not change a sum, and a text's common words are never shuffled. Rows are told apart
    whatever ids they have. Eager: it counts the weights, and writes ``df`` if they are joined.
    """
    known = weights.select("word", F.col("weight").cast("double").alias("weight"))
    if weights.count() <= broadcast_words:
        return df.withColumn(out, _total_of({row["word"]: row["weight"] for row in known.collect()})(F.lower(text)))
    sent = _frequent(df, text, known, broadcast_words)
    counted = _counted_by(sent)(F.lower(text))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), counted.alias("counted")).withColumn("number", F.monotonically_increasing_id())
    rows = settle(rows, "weighted-rows")
    counts = rows.select("number", F.explode("counted.rest").alias("rest")).select("number", "rest.*")
    totals = counts.join(known, "word").groupBy("number").agg(F.sum(F.col("n") * F.col("weight")).alias("total"))
    found = rows.join(totals, "number", "left")
    return found.select("row.*", (F.col("counted.total") + F.coalesce("total", F.lit(0.0))).alias(out))


def _frequent(df: DataFrame, text: Column, known: DataFrame, most: int, rows: int = 20_000) -> dict[str, float]:
    """The weights of up to ``most`` words that some ``rows`` rows have most often. Eager."""
    n = df.count()
    some = df if n <= rows else df.sample(rows / n, seed=7)
    counts = some.select(F.explode(_counted_by({})(F.lower(text))["rest"]).alias("rest")).groupBy("rest.word").agg(F.sum("rest.n").alias("n"))
    found = counts.join(known, "word").orderBy(F.desc("n"), "word").limit(most)
    return {row["word"]: row["weight"] for row in found.select("word", "weight").collect()}


def _coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row and code of each word, the words by code), without empty words."""
    split = pc.split_pattern_regex(texts.fill_null(""), NOT_LETTERS)
    rows = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    coded = pc.list_flatten(split).dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64) if len(coded) else np.empty(0, np.int64)
    real = codes != words.index("") if "" in words else np.ones(len(codes), bool)
    return rows[real], codes[real], words


def _counted_by(weights: dict[str, float]):
    """A struct of ``total``, the sum of the weights of words that are in ``weights``, and ``rest``, the others with their numbers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in text_slices(batch):
                rows, codes, words = _coded_words(part)
                values = np.array([weights.get(w, np.nan) for w in words], np.float64)
                sent = ~np.isnan(values[codes])
                total = np.bincount(rows[sent], values[codes[sent]], minlength=len(part))
                cells, counts = np.unique(rows[~sent] * max(len(words), 1) + codes[~sent], return_counts=True)
                owner, code = np.divmod(cells, max(len(words), 1))
                ends = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32))
                named = pa.array(words, pa.string()).take(pa.array(code))
                rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([named, pa.array(counts.astype(np.int32))], ["word", "n"]))
                done.append(pa.StructArray.from_arrays([pa.array(total), rest], ["total", "rest"]))
            yield pa.concat_arrays(done)

    # Non-deterministic only in name: its two parts are then not computed twice.
    return F.arrow_udf(run, "total double, rest array<struct<word:string,n:int>>").asNondeterministic()


def _total_of(weights: dict[str, float]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in text_slices(batch):
                rows, codes, words = _coded_words(part)
                values = np.array([weights.get(w, 0.0) for w in words], np.float64)
                done.append(pa.array(np.bincount(rows, values[codes], minlength=len(part)).astype(np.float64)))
            yield pa.concat_arrays(done)

    return F.arrow_udf(run, "double")


def cue_weights(df: DataFrame, text: Column, cue: Column, prior: float = 1000.0) -> DataFrame:
    """(word, n_cue, n_other, weight, z): how much likelier a word is in the texts for which ``cue`` holds than in the others.

    ``weight`` is the difference of the two log-odds under an informative Dirichlet prior: ``prior`` words, drawn from both corpora
    together; ``z`` is it over its standard deviation (Monroe, Colaresi and Quinn, "Fightin' Words", 2008). So a rare word gets
    no large weight by chance, and a word of both corpora none. Rows without a text or cue teach nothing. Words are counted before they are shuffled.
    Eager: the counts are written, their sums collected.
    """
    rows = df.where(text.isNotNull() & cue.isNotNull()).select(cue.cast("boolean").alias("cue"), F.explode(counted_words(text)).alias("word"))
    counts = rows.groupBy("word").agg(F.count_if("cue").alias("n_cue"), F.count_if(~F.col("cue")).alias("n_other"))
    table = settle(counts, "cue-words")
    total = table.agg(F.sum("n_cue").alias("cue"), F.sum("n_other").alias("other")).first()
    sides = {"n_cue": float(total["cue"] or 0), "n_other": float(total["other"] or 0)}
    both = sum(sides.values())
    expected = F.lit(prior) * (F.col("n_cue") + F.col("n_other")) / F.lit(both or 1.0)
    hits = {c: F.col(c) + expected for c in sides}
    odds = {c: F.log(hits[c] / (F.lit(n + prior) - hits[c])) for c, n in sides.items()}
    weight = F.when(hits["n_cue"] < F.lit(sides["n_cue"] + prior), F.when(hits["n_other"] < F.lit(sides["n_other"] + prior), odds["n_cue"] - odds["n_other"]))
    spread = F.sqrt(1 / hits["n_cue"] + 1 / hits["n_other"])
    weighted = table.withColumn("weight", F.coalesce(weight, F.lit(0.0)))  # a language of one word tells nothing
    return weighted.withColumn("z", F.col("weight") / spread)


def induced_polarity(df: DataFrame, text: Column, positive: Sequence[str], negative: Sequence[str], window: int = 4) -> DataFrame:
    """(word, n, near_positive, near_negative, weight): a word's polarity from the seed words it stands near.

    A pair is a word and another word at most ``window`` words away in the same text. ``weight`` is the positive pointwise mutual
    information of the word with the positive seeds, less that with the negative ones: in how far they meet more often than
    their numbers of pairs make likely, as a logarithm. ``n`` counts the word's pairs. A text's words find their seeds inside the row, and the counts
    are combined before the shuffle. Eager: the counts are written, their sums collected.
    """
    good, bad = set(positive), set(negative)

    def near(places: tuple[np.ndarray, np.ndarray], seed: np.ndarray) -> np.ndarray:
        """How many seeds each word has around it in its own text; ``places`` has the first and the end of them."""
        before = np.concatenate([[0], np.cumsum(seed)])
        return before[places[1]] - before[places[0]] - seed

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                rows, codes, words = _coded_words(part)
                at = np.arange(len(rows))
                first, end = np.searchsorted(rows, rows), np.searchsorted(rows, rows, "right")
                places = np.maximum(at - window, first), np.minimum(at + window + 1, end)
                lists = [np.array([w in seeds for w in words], np.int64) for seeds in (good, bad)]
                sums = [places[1] - places[0] - 1, *(near(places, seeds[codes]) for seeds in lists)]
                met = np.unique(codes[end - first > 1])
                columns = [np.bincount(codes, x, minlength=len(words)).astype(np.int64)[met] for x in sums]
                named = pa.array(words, pa.string()).take(pa.array(met))
                yield pa.RecordBatch.from_arrays([named, *map(pa.array, columns)], ["word", "n", "p", "q"])

    # A batch's words are counted in it, and its counts combined before the shuffle.
    rows = df.select(F.lower(text).alias("text")).mapInArrow(count, "word string, n long, p long, q long")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("p").alias("near_positive"), F.sum("q").alias("near_negative"))
    table = settle(counts, "polarity-words")
    total = table.agg(F.sum("n").alias("n"), F.sum("near_positive").alias("p"), F.sum("near_negative").alias("q")).first()

    def information(met: str, seeds: int | None) -> Column:
        ratio = F.col(met) * F.lit(float(total["n"] or 0)) / (F.col("n") * F.lit(float(seeds or 1)))
        return F.when(F.col(met) > 0, F.greatest(F.lit(0.0), F.log(ratio))).otherwise(0.0)

    weight = information("near_positive", total["p"]) - information("near_negative", total["q"])
    return table.withColumn("weight", weight)


def word_density(df: DataFrame, text: Column, weights: DataFrame, out: str) -> DataFrame:
    """``df`` with the sum of its words' weights per word; NULL for a text without a word."""
    totals = add_word_total(df, text, weights, "_total")
    return totals.withColumn(out, F.try_divide(F.col("_total"), F.size(counted_words(text)))).drop("_total")


def fit_monotone(df: DataFrame, score: Column, label: Column, width: float, bins: int = 64) -> list[float]:
    """The share of label 1 by bin of the score, made never to fall: isotonic regression.

    Bin i holds the scores from i * ``width``; lower and higher ones fall into the first and last. An empty bin gets what its
    neighbours allow, and without any label all are 0. NULL scores and labels do not count. Eager: one row per bin is collected.
    """
    rows = df.where(score.isNotNull() & label.isNotNull()).groupBy(score_bin(score, width, bins).alias("bin"))
    counts, hits = np.zeros(bins), np.zeros(bins)
    for row in rows.agg(F.count("*").alias("n"), F.sum(label.cast("int")).alias("hits")).collect():
        counts[row["bin"]], hits[row["bin"]] = row["n"], row["hits"]
    n, h = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(hits)])
    values = np.zeros(bins)
    for i in range(bins):
        # The greatest, over where a stretch around i may begin, of the least mean over where it may end.
        size, hit = n[i + 1 :][None, :] - n[: i + 1][:, None], h[i + 1 :][None, :] - h[: i + 1][:, None]
        mean = np.where(size > 0, hit / np.maximum(size, 1), np.nan)
        known = ~np.isnan(mean).all(1)
        values[i] = np.nanmin(mean[known], axis=1).max() if known.any() else (values[i - 1] if i else 0.0)
    return np.maximum.accumulate(values).tolist()


def score_bin(score: Column, width: float, bins: int) -> Column:
    return F.least(F.greatest(F.floor(score / F.lit(width)), F.lit(0)), F.lit(bins - 1)).cast("int")


def calibrated(score: Column, shares: Sequence[float], width: float) -> Column:
    """The share of the score's bin, NULL for NULL."""
    return F.when(score.isNotNull(), F.element_at(F.array(*map(F.lit, shares)), score_bin(score, width, len(shares)) + 1))
