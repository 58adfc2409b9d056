"""Class-based n-gram language model, with classes from exchange clustering.

A word's probability is that of its class after the two classes before it, times that of
the word within its class (Brown et al., "Class-Based n-gram Models of Natural Language",
1992). Classes are found by exchange (Kneser and Ney): each unit in turn
moves to the class that raises the likelihood of the corpus's class bigrams most.

Units are the most frequent words of all training documents, and for all other words their
endings, by a hash of so many values that few endings share one. Within an ending, a word
has its relative frequency, with half a count added to each and to one unseen word; so
probabilities sum to one over all words.

Words of three kinds by frequency: units of their own; the head, whose exact counts go to every task;
and the tail, without bound, whose counts are joined to the documents by an equi-join on
the words' hashes. Which words are in the head besides the units is read off a bounded sample and
does not change any result; all counts, and the choice of units, are taken over all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .tables import HashTable, broadcast_value
from .words import Words, chunks, mix, signed


@dataclass(frozen=True)
class LmRule:
    sample_docs: int = 6000
    head: int = 150_000
    units: int = 800
    endings: int = 1 << 16
    ending_bytes: int = 3
    classes: int = 64
    rounds: int = 6
    prior: float = 8.0  # what the shorter history counts for in the longer one

    @property
    def end(self) -> int:
        """The unit of the end of a text."""
        return self.units + self.endings


@dataclass
class Vocabulary:
    """The head: words that are units first, then the others; the unit of each."""

    table: HashTable  # values: number of the word
    unit: np.ndarray
    own: int  # how many words are units of their own

    def units_of(self, words: Words, rule: LmRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(head number or 0, whether in the head, unit) of each word."""
        row, known = self.table.find(words.hash)
        number = np.zeros(len(row), np.int64)
        number[known] = self.table.values[row[known]]
        unit = rule.units + endings_of(words, rule)
        unit[known] = self.unit[number[known]]
        return number, known, unit


def endings_of(words: Words, rule: LmRule) -> np.ndarray:
    value = np.zeros(len(words.end), np.uint64)
    for back in range(1, rule.ending_bytes + 1):
        at = words.end - back
        value = value * np.uint64(256) + np.where(at >= words.start, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(value) % np.uint64(rule.endings)).astype(np.int64)


def _with_ends(words: Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values per token with each text's end after its words; where each text begins."""
    out = np.full(len(values) + words.hi - words.lo, end, values.dtype)
    out[np.arange(len(values)) + words.text_of()] = values
    return out, words.first[:-1] + np.arange(words.hi - words.lo)


def _histories(unit: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The value before each token and the one before that; ends stand before a text."""
    last = np.concatenate([[end], unit[:-1]])
    before = np.concatenate([[end], last[:-1]])
    before[last == end] = end
    return before, last


def _head(docs: DataFrame, rule: LmRule) -> tuple[np.ndarray, np.ndarray]:
    """(word, ending) of the most frequent words of about ``sample_docs`` documents, drawn at random with a fixed seed."""
    n = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch, "text", lower=True):
                keys, at, n = np.unique(words.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(endings_of(words, rule)[at]), pa.array(n)], ["word", "ending", "n"])

    some = docs.where(F.rand(11) < min(1.0, rule.sample_docs / max(n, 1)))
    rows = some.select("text").mapInArrow(count, "word long, ending long, n long")
    top = rows.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    top = top.orderBy(F.desc("n"), "word").limit(rule.head).toArrow()
    return top.column("word").to_numpy(), top.column("ending").to_numpy()


def _word_counts(docs: DataFrame, head: np.ndarray, rule: LmRule) -> DataFrame:
    """(kind, key, ending, n) over all documents; kind 0: head words by their number, 2: other words."""
    sent = broadcast_value(docs.sparkSession, HashTable.of(head.view(np.uint64), np.arange(len(head))))

    def rows(kind: int, key: np.ndarray, n: np.ndarray, ending: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(ending), pa.array(n)], ["kind", "key", "ending", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        total = np.zeros(len(table.values), np.int64)
        for batch in batches:
            rare = []
            for words in chunks(batch, "text", lower=True):
                row, known = table.find(words.hash)
                total += np.bincount(table.values[row[known]], minlength=len(total))
                rare.append((words.hash[~known], endings_of(words, rule)[~known]))
            if rare:
                every, ending = (np.concatenate(x) for x in zip(*rare, strict=True))
                key, at, n = np.unique(every, return_index=True, return_counts=True)
                yield rows(2, signed(key), n, ending[at])
        at = np.flatnonzero(total)
        yield rows(0, at, total[at], np.zeros(len(at), np.int64))

    found = docs.select("text").mapInArrow(count, "kind int, key long, ending long, n long")
    return found.groupBy("kind", "key").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, rule: LmRule) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The head with the most frequent words of all documents as its units, its counts, and (key, ending, n) of the tail."""
    word, ending = _head(docs, rule)
    counts = settle(_word_counts(docs, word, rule), "counts")
    n, tail = _dense(counts.where("kind = 0"), len(word)), counts.where("kind = 2").drop("kind")
    # A frequent word that the sample hasn't joins the head.
    more = tail.orderBy(F.desc("n"), "key").limit(rule.units).toArrow()
    word, ending, n = (np.concatenate([x, more.column(c).to_numpy()]) for x, c in ((word, "key"), (ending, "ending"), (n, "n")))
    order = np.lexsort((word, -n))
    own = min(len(order), rule.units)
    sampled = np.arange(len(word)) < len(word) - len(more)
    order = np.concatenate([order[:own], order[own:][sampled[order[own:]]]])
    moved = word[order[:own]][~sampled[order[:own]]].tolist()
    if moved:
        tail = tail.where(~F.col("key").isin(moved))
    unit = np.concatenate([np.arange(own), rule.units + ending[order[own:]]])
    return Vocabulary(HashTable.of(word[order].view(np.uint64), np.arange(len(order))), unit, own), n[order], tail


def _pair_counts(docs: DataFrame, words: Vocabulary, rule: LmRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, the unit after it, how often) over all documents, of the pairs that occur."""
    sent = broadcast_value(docs.sparkSession, words)
    size = rule.end + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch, "text", lower=True):
                units, _ = _with_ends(words, sent.value.units_of(words, rule)[2], rule.end)
                key, n = np.unique(_histories(units, rule.end)[1] * size + units, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    found = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key = found.column("key").to_numpy()
    order = np.argsort(key)  # the order of tasks must not matter
    return key[order] // size, key[order] % size, found.column("n").to_numpy()[order].astype(float)


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """The class of each unit, from the matrix of how often unit j follows unit i."""
    first, second = np.nonzero(pairs)
    return exchange_pairs(first, second, pairs[first, second], len(pairs), classes, rounds)


def exchange_pairs(first: np.ndarray, second: np.ndarray, n: np.ndarray, units: int, classes: int, rounds: int) -> np.ndarray:
    """The class of each unit, from how often unit ``second`` follows unit ``first``, in the order of first and second.

    Starts with the units dealt out by frequency; ends after ``rounds``, or when a round moves none.
    """
    frequency = np.bincount(second, n, minlength=units)
    by_second = np.argsort(second, kind="stable")
    before_unit, before_n = first[by_second], n[by_second]
    row, column = (np.searchsorted(x, np.arange(units + 1)) for x in (first, second[by_second]))
    order = np.argsort(-frequency, kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes

    def gain(x):
        return x * np.log(np.maximum(x, 1))

    table = np.bincount(of[first] * classes + of[second], n, minlength=classes * classes).reshape(classes, classes)
    for _ in range(rounds):
        moved = 0
        for unit in order[frequency[order] > 0]:
            here = of[unit]
            out, into = slice(row[unit], row[unit + 1]), slice(column[unit], column[unit + 1])
            self_pairs = float(n[out][second[out] == unit].sum())
            after = np.bincount(of[second[out]], n[out], minlength=classes)
            before = np.bincount(of[before_unit[into]], before_n[into], minlength=classes)
            after[here] -= self_pairs
            before[here] -= self_pairs
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= self_pairs
            rows, columns = table.sum(1), table.sum(0)
            old = gain(table)
            diagonal = np.diag(table)
            value = (gain(table + after) - old).sum(1) + (gain(table + before[:, None]) - old).sum(0)
            # The class's own cell takes both sides at once.
            value -= gain(diagonal + after) + gain(diagonal + before) - 2 * gain(diagonal)
            value += gain(diagonal + after + before + self_pairs) - gain(diagonal)
            value -= gain(rows + after.sum() + self_pairs) - gain(rows) + gain(columns + before.sum() + self_pairs) - gain(columns)
            best = int(value.argmax())
            if value[best] <= value[here] + 1e-9:
                best = here
            moved += best != here
            of[unit] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += self_pairs
        if not moved:
            break
    return of


@dataclass
class Tables:
    """What scoring needs in every task; logarithms to base 10."""

    words: Vocabulary
    unit_class: np.ndarray
    unit_score: np.ndarray  # of a unit within its class
    head_known: np.ndarray
    head_base: np.ndarray  # of count + 0.5
    head_score: np.ndarray  # of a word within its unit
    tail_score: np.ndarray  # per ending: what a tail word's own logarithm is lessened by
    transition: np.ndarray  # class after two classes
    end_base: float
    end_known: bool


@dataclass
class LanguageModel:
    rule: LmRule
    tables: Tables
    tail: DataFrame  # word, n
    train_tokens: int
    base_divisor: float


def _transitions(docs: DataFrame, words: Vocabulary, unit_class: np.ndarray, rule: LmRule) -> np.ndarray:
    """How often each class follows two classes, over all documents."""
    c = rule.classes
    sent = broadcast_value(docs.sparkSession, (words, unit_class))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, unit_class = sent.value
        total = np.zeros(c**3, np.int64)
        for batch in batches:
            for words in chunks(batch, "text", lower=True):
                units, _ = _with_ends(words, vocabulary.units_of(words, rule)[2], rule.end)
                before, last = _histories(units, rule.end)
                total += np.bincount((unit_class[before] * c + unit_class[last]) * c + unit_class[units], minlength=c**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "n"])

    found = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return _dense(found, c**3).reshape(c, c, c).astype(float)


def _dense(counts: DataFrame, size: int) -> np.ndarray:
    """(key, n) with keys below ``size``, collected into one array."""
    table = counts.select("key", "n").toArrow()
    out = np.zeros(size, np.int64)
    out[table.column("key").to_numpy()] = table.column("n").to_numpy()
    return out


def fit_classes(docs: DataFrame, rule: LmRule = LmRule()) -> LanguageModel:
    """Learn from all documents with a ``text``; a null one is empty, and each ends with one end.

    Only the head's counts, the pairs of units that occur and the transitions between classes
    reach the driver. Eager: it reads the documents three times, besides the sample, and
    writes the words' counts.
    """
    words, head, tail = vocabulary(docs, rule)
    first, second, n = _pair_counts(docs, words, rule)
    unit_class = exchange_pairs(first, second, n, rule.end + 1, rule.classes, rule.rounds)

    by_unit = np.bincount(second, n, minlength=rule.end + 1)
    in_class = np.bincount(unit_class, by_unit, minlength=rule.classes)
    units_in = np.bincount(unit_class, minlength=rule.classes)
    add = 0.01  # for units that never occurred
    unit_score = np.log10((by_unit + add) / (in_class + add * units_in)[unit_class])

    # Within an ending: tokens and different words, of the head and of the tail.
    tokens, types = by_unit[rule.units : rule.end], np.zeros(rule.endings)
    rest = np.arange(len(head)) >= words.own
    types += np.bincount((words.unit - rule.units)[rest & (head > 0)], minlength=rule.endings)[: rule.endings]
    for r in tail.groupBy("ending").count().collect():
        types[r[0]] += r[1]
    tail_score = np.log10(tokens + 0.5 * (types + 1))
    head_score = np.zeros(len(head))
    head_score[rest] = np.log10(head[rest] + 0.5) - tail_score[(words.unit - rule.units)[rest]]

    ends = float(by_unit[rule.end])
    train_tokens = int(n.sum())
    distinct = int((head > 0).sum()) + tail.count() + (ends > 0)
    three = _transitions(docs, words, unit_class, rule)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + rule.prior * p1) / (two.sum(1, keepdims=True) + rule.prior)
    p3 = (three + rule.prior * p2) / (three.sum(2, keepdims=True) + rule.prior)
    tables = Tables(words, unit_class, unit_score, head > 0, np.log10(head + 0.5), head_score, tail_score, np.log10(p3).reshape(-1), float(np.log10(ends + 0.5)), ends > 0)
    return LanguageModel(rule, tables, tail.select(F.col("key").alias("word"), F.col("n").alias("count")), train_tokens, float(np.log10(train_tokens + 0.5 * (distinct + 1))))


def _rows(docs: DataFrame) -> DataFrame:
    """Rows named by id and text alike; equal rows share the name."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def score_texts(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score, score (logarithms to base 10 of the text's probability).

    ``base_score`` is that of a unigram model of the same counts. Texts are read whole; other columns are not read.
    """
    rule, c = model.rule, model.rule.classes
    sent = broadcast_value(docs.sparkSession, model.tables)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            for words in chunks(batch, "text", lower=True):
                number, known, unit = t.words.units_of(words, rule)
                own = np.zeros(len(unit))
                base = np.zeros(len(unit))
                own[known], base[known] = t.head_score[number[known]], t.head_base[number[known]]
                own[~known] = -t.tail_score[unit[~known] - rule.units]
                counted = np.zeros(len(unit), np.int64)
                counted[known] = t.head_known[number[known]]
                units, first = _with_ends(words, unit, rule.end)
                before, last = _histories(units, rule.end)
                score = t.transition[(t.unit_class[before] * c + t.unit_class[last]) * c + t.unit_class[units]] + t.unit_score[units]
                score += _with_ends(words, own, 0.0)[0]
                size = words.hi - words.lo
                sums = [np.add.reduceat(x, first) for x in (_with_ends(words, counted, int(t.end_known))[0], _with_ends(words, base, t.end_base)[0], score)]
                ids = [batch.column(x).slice(words.lo, size) for x in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(words.counts + 1), *map(pa.array, sums)], ["doc_id", "row", "n_tokens", "known", "base", "model"])

    def tail_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.words.table
        for batch in batches:
            row = batch.column("row").to_numpy()
            for words in chunks(batch, "text", lower=True):
                rare = ~table.find(words.hash)[1]
                text, h = words.text_of()[rare], words.hash[rare]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(row[words.lo + text])], ["word", "row"])

    rows = _rows(docs)
    direct = rows.mapInArrow(in_task, "doc_id long, row long, n_tokens long, known long, base double, model double")
    tails = rows.select("row", "text").mapInArrow(tail_words, "word long, row long")
    # Only words that training has are joined; the others count as nought.
    n = F.coalesce("count", F.lit(0))
    joined = tails.join(model.tail.hint("shuffle_hash"), "word", "left")
    by_row = joined.groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("tail"), F.sum((n > 0).cast("long")).alias("tail_known"))
    same = rows.groupBy("row").agg(F.count("*").alias("copies"))  # equal rows have added up their words
    found = direct.join(by_row, "row", "left").join(same, "row")
    tail = F.coalesce(F.col("tail") / F.col("copies"), F.lit(0.0))
    known = F.coalesce((F.col("tail_known") / F.col("copies")).cast("long"), F.lit(0))
    return found.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + known).alias("n_known"),
        (F.col("base") + tail - F.col("n_tokens") * F.lit(model.base_divisor)).alias("base_score"),
        (F.col("model") + tail).alias("score"),
    )
