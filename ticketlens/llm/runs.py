"""Periodic runs of words: stretches that repeat a shorter stretch three times or more.

An online dynamic program over diagonals. A diagonal is a lag q; its match length at word i counts
how many words up to i equal the word q before. Going through the words in order, the earlier
occurrences of what ends at word i increment the lengths of their lags; a diagonal that is
not incremented has ended, and is emitted at once if it is long enough.

The program is kept sparse without losing a run. A run of period q has a match length of
``least(q) = max(24 - q, 2 q)`` at least, hence k matching words in a row for any k up to that. With k the least power of two
that is neither below q nor below 16, k <= least(q), and inside the run the *latest* earlier occurrence of the k
words that end at i is the one at lag q: one at a smaller lag, overlapping by k >= q words,
would give the run a smaller period. So for each k only lags above k / 2 (all, for 16) of latest
earlier occurrences are active: at most one lag a word and k, however often a word
occurs. A text of n equal words takes n steps, not n**2.

Conversely a diagonal of that kind that ends with ``least(q)`` matches is a run, complete and with smallest period q: a
smaller period would divide q (the stretch is 3 q long) and would have been the latest occurrence.

Which k words are equal is told exactly: k words get the number of their pair of k / 2 words each,
by sorting; those that occur once in their text are left out of the next round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import pieces, texts_of

RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
_RUN_ARROW = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))

LEAST_WORDS, LEAST_TIMES = 24, 3
_SMALLEST = 16  # words; any run has that many matches in a row: max(24 - q, 2 q) >= 16

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _least(period: int) -> int:
    return max(LEAST_WORDS, LEAST_TIMES * period) - period


def _numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of some texts, the same for equal words of one text only; where each word's text ends."""
    numbers: list[int] = []
    for text in words:
        first = len(numbers)
        seen: dict[bytes, int] = {}
        numbers += [seen.setdefault(w, first + len(seen)) for w in text]
    lengths = [len(text) for text in words]
    return np.array(numbers, np.int64), np.repeat(np.cumsum(lengths), lengths)


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entries have a key that occurs again, a number for each of their keys)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    number = np.cumsum(new) - 1
    size = np.bincount(number)
    again = size[number] > 1
    kept, number = order[again], number[again]
    back = np.argsort(kept)
    return kept[back], number[back]


def latest_occurrences(words: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, words, lags) for k = 16, 32, ...: the k words that end there stand ``lag`` words earlier too, and nowhere between.

    Only lags of at most k, and above k / 2 beyond 16. Words are numbered through all texts.
    """
    numbers, ends = _numbered(words)
    if not len(numbers):
        return
    at, name = _twice(numbers)
    k = 1
    dense = np.full(len(numbers), -1, np.int64)
    while len(at):
        if k >= _SMALLEST:
            order = np.argsort(name, kind="stable")
            place = at[order]
            lag = np.diff(place)
            near = (np.diff(name[order]) == 0) & (lag <= k) & ((lag > k // 2) | (k == _SMALLEST))
            found = np.flatnonzero(near)
            if len(found):
                later = place[found + 1] + k - 1
                order = np.argsort(later)
                yield k, later[order], lag[found][order]
        # Names of 2 k words from those of the first and the second k.
        dense[:] = -1
        dense[at] = name
        both = at + 2 * k <= ends[at]
        at, name = at[both], name[both]
        second = dense[at + k]
        both = second >= 0
        at, name, second = at[both], name[both], second[both]
        kept, name = _twice(name * (len(numbers) + 1) + second) if len(at) else (at, name)
        at, k = at[kept] if len(at) else at, 2 * k


def diagonals(k: int, at: np.ndarray, lags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the diagonals that end with enough matches, for one k: the online pass over its events."""
    lag, length, last = 0, 0, -2
    for i, q in zip(at.tolist(), lags.tolist(), strict=True):
        if q == lag and i == last + 1:
            length += 1
        else:  # this lag was not incremented at the word after ``last``: its diagonal has ended there
            if lag and length >= _least(lag):
                yield last + 1 - length - lag, length + lag, lag
            lag, length = q, k  # the k words that match are its first matches
        last = i
    if lag and length >= _least(lag):
        yield last + 1 - length - lag, length + lag, lag


def find_runs(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text its runs as (start, length, period), by start, then period."""
    first = np.cumsum([0] + [len(text) for text in words])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for k, at, lags in latest_occurrences(words):
        for start, length, period in diagonals(k, at, lags):
            text = int(np.searchsorted(first, start, side="right")) - 1
            runs[text].append((start - int(first[text]), length, period))
    for found in runs:
        found.sort(key=lambda run: (run[0], run[2]))
    return runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that stand in a run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed_text.

    Words are the runs of bytes other than space and \\t \\n \\v \\f \\r; a run of words has a smallest period q, at least
    ``max(24, 3 q)`` words, and no neighbour that would prolong it. ``runs`` is an array of (start, length, period) by
    start, then period. ``collapsed_text`` has the words outside of runs and each run's first period, one space
    apart. ``rewrite`` may change the words of a row, given its doc_id, before all this.

    A null or empty text has no words, an empty array and an empty text. Texts are read whole; a very long one is
    worked on alone. Rows that repeat a doc_id are rows of their own, a null doc_id stays null, other columns are not read. Nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            texts = texts_of(batch, "text")
            for lo, hi in pieces(texts):
                words = [(t or b"").split() for t in texts[lo:hi]]
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(ids.slice(lo, hi - lo).to_pylist(), words, strict=True)]
                runs = find_runs(words)
                kept = [b" ".join(collapse(w, r)) for w, r in zip(words, runs, strict=True)]
                found = [[dict(zip(("start", "length", "period"), run, strict=True)) for run in r] for r in runs]
                columns = [
                    ids.slice(lo, hi - lo),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(found, _RUN_ARROW),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed_text"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed_text", T.StringType())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def most_repeated(runs: Column) -> Column:
    """The run that repeats most often, length / period compared exactly; of equal ones the first. Null without runs."""
    best = F.slice(runs, 1, 1)
    later = F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0)))
    more = lambda run, b: run["length"] * b["period"] > b["length"] * run["period"]
    return F.when(F.size(runs) > 0, F.aggregate(later, F.get(best, F.lit(0)), lambda b, run: F.when(more(run, b), run).otherwise(b)))
