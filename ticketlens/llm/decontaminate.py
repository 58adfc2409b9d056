"""Benchmark items in training documents, exact, edited or paraphrased.

All word n-grams of a benchmark item are its seeds, however many documents have them. Where a
document has one, the passage around it is aligned to the item by Smith-Waterman over words,
so that changed, left out and added words only lower the score. A passage is left out of that only if
the item's words that stand in it, in whatever order, can't reach the score. Words that many documents have
count half, or passages would be alike by their everyday words alone; but not words that
are common by the item's own passages, as those of an item that leaked into a third of all documents.

The benchmark goes to the documents, in blocks of a stated number of words; the documents
stay where they are, and nothing is shuffled but one count per word and task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import HashTable, broadcast_value
from .words import Words, pieces, sequence_hashes, signed, split, texts_of

_NOT_WORD = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class LeakRule:
    """A passage leaks an item if its alignment score reaches ``least_score`` of a perfect copy's.

    Words score ``match`` (half of it if more than a share ``common`` of the documents have the
    word), ``mismatch`` and ``gap`` (each added or left-out word). A word scores ``match`` all the same if at least half
    of its documents, and all but a share ``common`` of all documents, have it only in the item's own passages:
    those that reach ``least_score`` with every word at ``match`` and are more like no other item.
    ``seed`` is the length of the n-grams; items of fewer words, and passages that share no
    n-gram with the item, are never found.
    """

    seed: int = 3
    least_score: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    common: float = 0.05
    block_words: int = 1_000_000


@dataclass
class Seen:
    """In how many documents each word of the items occurs, of how many."""

    documents: int
    words: dict[int, int]
    inside: dict[int, int]  # by place in Items.hashes: documents that have the word in passages like its item only


@dataclass
class Items:
    """Benchmark items of one block: hashes of all words, item after item, and their seeds."""

    ids: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    seeds: HashTable  # values: where the seed's occurrences begin in places; one more column: how many
    item: np.ndarray  # per occurrence, ordered by seed
    place: np.ndarray  # word in the item
    score: np.ndarray  # per word of all items: what its match scores

    @staticmethod
    def of(ids: np.ndarray, first: np.ndarray, hashes: np.ndarray, rule: LeakRule) -> Items:
        n = rule.seed
        grams = sequence_hashes(hashes, n)
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        at = np.flatnonzero(item[: len(grams)] == item[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        at = at[np.argsort(grams[at], kind="stable")]
        keys, begin, times = np.unique(grams[at], return_index=True, return_counts=True)
        seeds = HashTable.of(keys, np.stack([begin, times], 1))
        return Items(ids, first, hashes, seeds, item[at], at - first[item[at]], np.full(len(hashes), rule.match))

    def weighed(self, seen: Seen, rule: LeakRule) -> Items:
        """Common words score half, but not those that the item itself made common."""
        having = np.array([seen.words.get(int(h), 0) for h in self.hashes], np.int64)
        inside = np.array([seen.inside.get(i, 0) for i in range(len(self.hashes))], np.int64)
        least, outside = rule.common * seen.documents, having - inside
        common = (having > least) & ((outside > least) | (inside < outside))
        return replace(self, score=np.where(common, rule.match // 2, rule.match))


def _normal(text: bytes | None) -> bytes | None:
    return _NOT_WORD.sub(" ", text.decode().lower()).encode() if text else None


def _hits(words: Words, items: Items, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, row in the seed table) of each seed in the texts."""
    grams = sequence_hashes(words.hash, n)
    row, found = items.seeds.find(grams)
    at = np.flatnonzero(found)
    text = words.text_of()
    at = at[text[at] == text[at + n - 1]]
    return text[at], at, row[at]


def align(passages: list[np.ndarray], item: np.ndarray, scores: np.ndarray, rule: LeakRule) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of the item with each passage, and where it ends in the passage.

    Smith-Waterman with a linear gap cost, a row of all passages at a time; the gap along the row is a
    running maximum.
    """
    width = max(map(len, passages))
    text = np.zeros((len(passages), width), np.uint64)
    real = np.zeros((len(passages), width), bool)
    for i, p in enumerate(passages):
        text[i, : len(p)], real[i, : len(p)] = p, True
    slope = -rule.gap * np.arange(width)
    above = np.zeros((len(passages), width + 1), np.int64)
    best, end = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64)
    for word, match in zip(item, scores, strict=True):
        step = above[:, :-1] + np.where((text == word) & real, match, rule.mismatch)
        step = np.maximum(np.maximum(step, above[:, 1:] + rule.gap), 0)
        above[:, 1:] = np.maximum.accumulate(step + slope, axis=1) - slope
        at = above[:, 1:].argmax(1)
        top = above[np.arange(len(passages)), at + 1]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


class _Places:
    """Where the words of some texts stand, by word."""

    def __init__(self, words: Words):
        order = np.argsort(words.hash, kind="stable")
        self.at = order
        self.keys, self.begin, self.times = np.unique(words.hash[order], return_index=True, return_counts=True)
        self.size = len(order) + 1
        # One rising number per word and place, so that places in a stretch are two searches.
        self.rising = np.repeat(np.arange(len(self.keys)), self.times) * self.size + order

    def count(self, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often each wanted word stands in its stretch, from lo to before hi."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64)
        of = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        n = np.searchsorted(self.rising, of * self.size + hi) - np.searchsorted(self.rising, of * self.size + lo)
        return np.where(self.keys[of] == wanted, n, 0)


def _passages(words: Words, items: Items, rule: LeakRule, places: _Places) -> dict[int, list[tuple[int, int, int]]]:
    """Per item the stretches (text, first word, end) that seeds point at, merged where they meet.

    Without those whose words can't reach the least score in any order.
    """
    text, at, row = _hits(words, items, rule.seed)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(row):
        return out
    begin, n = items.seeds.values[row].T
    # Whole texts at a time, as a seed may stand in many items.
    ends = np.flatnonzero(np.append(np.diff(text) > 0, True)) + 1
    part = np.cumsum(n)[ends - 1] // (1 << 20)
    cuts = [0, *ends[np.append(np.diff(part) > 0, True)].tolist()]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for item, *stretch in _stretches(words, items, rule, places, text[a:b], at[a:b], begin[a:b], n[a:b]):
            out.setdefault(item, []).append(tuple(stretch))
    return out


def _stretches(words: Words, items: Items, rule: LeakRule, places: _Places, text, at, begin, n) -> Iterator[tuple[int, ...]]:
    each = np.repeat(np.arange(len(at)), n)
    where = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    item, text, size = items.item[where], text[each], np.diff(items.first)
    start = at[each] - items.place[where]
    margin = size[item] // 4 + 2
    lo = np.maximum(start - margin, words.first[text])
    hi = np.minimum(start + size[item] + margin, words.first[text + 1])
    order = np.lexsort((lo, text, item))
    item, text, lo, hi = item[order], text[order], lo[order], hi[order]
    # All of an item's stretches are equally long, so ends rise with beginnings.
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])]))
    last = np.append(new[1:], len(lo)) - 1
    item, text, lo, hi = item[new], text[new], lo[new], hi[last]
    perfect = np.add.reduceat(np.append(items.score, 0), items.first[:-1]) * (size > 0)
    step = max(1, (1 << 20) // int(size.max()))
    for k in range(0, len(item), step):
        some = slice(k, k + step)
        of, length = item[some], size[item[some]]
        ends = np.cumsum(length)
        word = np.arange(ends[-1]) + np.repeat(items.first[of] - ends + length, length)
        there = places.count(items.hashes[word], np.repeat(lo[some], length), np.repeat(hi[some], length)) > 0
        bound = np.add.reduceat(items.score[word] * there, ends - length)
        good = np.flatnonzero(bound >= rule.least_score * perfect[of]) + k
        yield from zip(item[good].tolist(), text[good].tolist(), lo[good].tolist(), hi[good].tolist(), strict=True)


def _aligned(words: Words, items: Items, rule: LeakRule, places: _Places) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, text, first word and end of the best passage, its score) of stretches that reach the least score."""
    for item, stretches in _passages(words, items, rule, places).items():
        of = slice(items.first[item], items.first[item + 1])
        wanted, scores = items.hashes[of], items.score[of]
        least = rule.least_score * int(scores.sum())
        at = 0
        stretches.sort(key=lambda s: s[2] - s[1])
        while at < len(stretches):
            size = max(1, min(512, (1 << 20) // (stretches[at][2] - stretches[at][1] + 1)))
            some = stretches[at : at + size]
            at += size
            score, end = align([words.hash[lo:hi] for _, lo, hi in some], wanted, scores, rule)
            for i in np.flatnonzero(score >= least).tolist():
                t, lo, _ = some[i]
                stop = lo + int(end[i])
                _, back = align([words.hash[lo:stop][::-1]], wanted[::-1], scores[::-1], rule)
                yield item, t, stop - int(back[0]), stop, int(score[i])


def _own(aligned: Iterator[tuple[int, int, int, int, int]], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(item, text, first word, end) of passages that no other item is more like, of those that share half of the shorter one."""
    by_text: dict[int, list[tuple[float, int, int, int]]] = {}
    for item, t, lo, hi, score in aligned:
        perfect = int(items.score[items.first[item] : items.first[item + 1]].sum())
        by_text.setdefault(t, []).append((score / perfect, item, lo, hi))
    for t, found in by_text.items():
        share, _, lo, hi = (np.array(x) for x in zip(*found, strict=True))
        for s, item, a, b in found:
            both = np.minimum(hi, b) - np.maximum(lo, a)
            if not ((share > s) & (2 * both > np.minimum(hi - lo, b - a))).any():
                yield item, t, a, b


def _matches(words: Words, items: Items, rule: LeakRule) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, start, end): the best passage of each document for each item it leaks."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for item, t, lo, hi, score in _aligned(words, items, rule, _Places(words)):
        perfect = int(items.score[items.first[item] : items.first[item + 1]].sum())
        found = (score / perfect, lo - int(words.first[t]), hi - int(words.first[t]))
        if (t, item) not in best or (found[0], -found[1]) > (best[t, item][0], -best[t, item][1]):
            best[t, item] = found
    return [(t, item, *found) for (t, item), found in sorted(best.items())]


def _blocks(benchmark: DataFrame, rule: LeakRule) -> list[Items]:
    """The benchmark's words, collected in blocks of a bounded number of words; a longer item is a block alone."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    sized = rows.withColumn("n", F.size(F.split("text", " ")))
    blocks = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // rule.block_words))
    out = []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        words = split([_normal(r["text"].encode()) for r in part], 0, len(part))
        out.append(Items.of(np.array([r["item_id"] for r in part], np.int64), words.first, words.hash, rule))
    return out


def _seen(docs: DataFrame, items: Items, rule: LeakRule) -> Seen:
    """One pass over the documents, which counts per task; ``items`` as they are, with all words at full score."""
    vocabulary = np.unique(items.hashes)
    sent = broadcast_value(docs.sparkSession, (items, HashTable.of(vocabulary, np.arange(len(vocabulary)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = sent.value
        documents, having, inside = np.zeros(1, np.int64), np.zeros(len(known.keys), np.int64), np.zeros(len(items.hashes), np.int64)
        for batch in batches:
            texts = [_normal(t) for t in texts_of(batch, "text")]
            documents += len(texts)
            for lo, hi in pieces(texts):
                words = split(texts, lo, hi)
                row, found = known.find(words.hash)
                size = max(len(having), 1)
                having += np.bincount(np.unique(words.text_of()[found] * size + row[found]) % size, minlength=len(having))
                places = _Places(words)
                within: dict[tuple[int, int], np.ndarray] = {}  # per text and item, how often each of its words stands in such passages
                for item, t, lo, hi in _own(_aligned(words, items, rule, places), items):
                    wanted = items.hashes[items.first[item] : items.first[item + 1]]
                    within[t, item] = within.get((t, item), 0) + places.count(wanted, *(np.full(len(wanted), x) for x in (lo, hi)))
                for (t, item), n in within.items():
                    of = slice(items.first[item], items.first[item + 1])
                    whole = places.count(items.hashes[of], *(np.full(len(n), x) for x in words.first[t : t + 2]))
                    inside[of] += (whole > 0) & (n == whole)
        for kind, keys, values in ((0, np.zeros(1, np.int64), documents), (1, signed(known.keys), having), (2, np.arange(len(inside)), inside)):
            at = np.flatnonzero(values)
            columns = [np.full(len(at), kind, np.int64), keys[at], values[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "kind long, key long, n long")
    found: list[dict[int, int]] = [{}, {}, {}]
    for kind, key, n in rows.groupBy("kind", "key").agg(F.sum("n")).collect():
        found[kind][key % (1 << 64)] = n
    return Seen(found[0].get(0, 0), found[1], found[2])


def leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, score (to 1), start, end.

    ``start`` and ``end`` count the document's words (letters and digits, in lower case) of its best
    passage. Null and empty texts hold nothing; items without an id or text are left
    out. Rows that repeat a doc_id each have their own rows. Other columns are not
    read. Eager: it reads the documents once to count words.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for items in _blocks(benchmark, rule):
        sent = broadcast_value(docs.sparkSession, items.weighed(_seen(docs, items, rule), rule))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, ids = [_normal(t) for t in texts_of(batch, "text")], batch.column("doc_id").to_pylist()
                for lo, hi in pieces(texts):
                    some = _matches(split(texts, lo, hi), sent.value, rule)
                    columns = [[ids[lo + m[0]] for m in some], [int(sent.value.ids[m[1]]) for m in some], *([m[k] for m in some] for k in (2, 3, 4))]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "start", "end"])

        part = rows.mapInArrow(search, "doc_id long, item_id long, score double, start long, end long")
        found = part if found is None else found.union(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are. Nothing is shuffled."""
    kept = docs
    for items in _blocks(benchmark, rule):
        sent = broadcast_value(docs.sparkSession, items.weighed(_seen(docs, items, rule), rule))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [_normal(t) for t in texts_of(batch, "text")]
                keep = np.ones(len(texts), bool)
                for lo, hi in pieces(texts):
                    for match in _matches(split(texts, lo, hi), sent.value, rule):
                        keep[lo + match[0]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(clean, T.StructType(docs.schema.fields))
    return kept
