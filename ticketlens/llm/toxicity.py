"""Toxicity by nearest labelled examples.

Examples and passages of documents are TF-IDF vectors: (1 + ln tf) times idf, scaled to length 1, over all terms of the examples. Terms are
words and beginnings of words, which tell the stem of a word never seen; labels have no part in the vectors. A document is searched for
by its passages, all of them, and is as toxic as the most toxic one: few words of a long text say so. The nearest examples by
cosine are found exactly, for many documents at once, in an inverted index in blocks of examples. Terms of few examples are essential: their
postings are added up first. The others are common, and bounded before they are added: per block of examples a term has its
greatest weight there. A block whose best sum so far and bound together do not reach the k-th best similarity is never looked at; the
blocks of the greatest bounds go first and raise that similarity. Sums are in single precision first, which tells of most passages
that they are not a document's most toxic one; of the others the neighbours are told in double precision. The neighbours vote with weights
that fall with their distance, and the votes are calibrated on the examples themselves, each without its own vote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle
from .tables import HashTable, broadcast_for_workers, broadcast_value, sampled_by_class
from .words import Words, char_prefixes, mix, pieces, split, texts_of

_ROUGH = 1e-5  # more than single precision is off by
_CLOSE = 1e-3  # more than votes are off by, and their difference, if similarities are off by _ROUGH

_NOT_LETTERS = re.compile(r"[\W\d_]")

#: Passages that are searched at once: their similarities to all examples are one array.
TOGETHER = 256

#: Passages whose postings are listed at once.
LISTED = 8

#: Essential terms of at least this share of a common term's examples have rows of weights in place of postings.
ROW_SHARE = 0.5

#: Bytes of these rows; the terms of the most examples come first, the others keep to their postings.
ROW_BYTES = 32 << 20

#: ASCII in lower case with spaces for all but letters; other bytes as they are.
_ASCII = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def _clean(text: bytes | None) -> bytes | None:
    """Lower case, and a space for each character that is no letter."""
    if not text or text.isascii():
        return text.translate(_ASCII) if text else None
    lower = text.decode().lower()
    odd = {ord(c): " " for c in set(lower) if c > "\x7f" and _NOT_LETTERS.match(c)}
    return (lower.translate(odd) if odd else lower).encode().translate(_ASCII)


def passages(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, text of each passage): texts are cut after every ``length`` words, and all words are in one."""
    text = words.text_of()
    place = np.arange(len(text)) - words.first[:-1][text]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] % length == 0)])[: len(text)]
    return np.cumsum(new) - 1, text[new]


def occurrences(words: Words, prefixes: tuple[int, ...], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and every beginning, of ``prefixes`` characters, of a longer word. ``text`` is each word's own."""
    texts, hashes = [text], [mix(words.hash)]
    for n in prefixes:
        owner, h = char_prefixes(words, n)
        texts.append(text[owner])
        hashes.append(mix(h + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(hashes)


def term_counts(words: Words, prefixes: tuple[int, ...], text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, occurrences) of the terms of every text."""
    text, hashed = occurrences(words, prefixes, text)
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.flatnonzero(np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])])[: len(text)])
    return text[new], hashed[new], np.diff(np.append(new, len(text)))


@dataclass
class Examples:
    """The index, and what is needed to vote. Examples are numbered in index order."""

    prefixes: tuple[int, ...]
    terms: HashTable  # hash to term
    idf: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    weight: np.ndarray  # rows of its class that an example stands for
    first: np.ndarray  # where a term's postings begin, and the end
    column: np.ndarray  # example of each posting, and which of the levels it has: in few bytes, as reading them takes most of the time
    level: np.ndarray
    levels: np.ndarray  # 1 + ln of the occurrences that there are
    length: np.ndarray  # of each example's vector before it is scaled to 1
    k: int
    passage: int  # words of a text that are searched for together
    block: int
    common_from: int  # examples of a term from which on it is common
    empty_score: float  # of texts without any term
    steps: tuple[np.ndarray, np.ndarray]  # calibration: votes and scores

    def __post_init__(self):
        self._ready = False

    def __getstate__(self):
        return {**self.__dict__, "_ready": False, **dict.fromkeys(("place", "exact", "rows", "scale", "dense", "block_max", "postings"))}

    def prepare(self) -> None:
        """The common terms' weights as a matrix, their greatest by block, and the rows and postings of the others; made where they are used."""
        counts = np.diff(self.first)
        common = np.flatnonzero(counts >= self.common_from)
        self.width = -(-max(len(self.ids), 1) // self.block) * self.block
        by_row = np.flatnonzero((counts < self.common_from) & (counts >= max(2, self.common_from * ROW_SHARE)))
        by_row = by_row[np.argsort(-counts[by_row], kind="stable")[: ROW_BYTES // (4 * self.width)]]
        self.n_common = len(common)
        self.place = np.full(len(counts), -1)
        self.place[np.concatenate([common, by_row])] = np.arange(len(common) + len(by_row))
        row = np.repeat(self.place, counts)
        self.exact = np.zeros((self.width, len(common) + len(by_row)))
        held, idf = row >= 0, np.repeat(self.idf, counts)
        self.exact[self.column[held], row[held]] = self.levels[self.level[held]] * idf[held] / self.length[self.column[held]]
        self.rows = np.ascontiguousarray(self.exact[:, len(common) :].T, np.float32)
        self.scale = np.zeros(self.width)
        self.scale[: len(self.length)] = 1 / self.length
        # Per block its examples' weights, one after the other.
        blocks = self.exact[:, : len(common)].reshape(self.width // self.block, self.block, len(common))
        self.dense = np.ascontiguousarray(blocks.transpose(0, 2, 1), np.float32)
        self.block_max = np.ascontiguousarray(self.dense.max(2, initial=0).T)
        # A posting is one number: looking it up costs more than taking it apart.
        self.bits = len(self.levels).bit_length()
        self.postings = (self.column.astype(np.int64) << self.bits | self.level).astype(np.uint32 if self.width << self.bits < 1 << 32 else np.int64)
        self._ready = True

    def vectors(self, words: Words, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, term, weight) of the owners' terms, by owner; terms that no example has are left out, as in any fitted vocabulary."""
        text, hashed = occurrences(words, self.prefixes, owner)
        at, known = self.terms.find(hashed)
        both = np.sort(text[known] * len(self.idf) + self.terms.values[at[known]])
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
        text, term = np.divmod(both[new], max(len(self.idf), 1))
        weight = (1 + np.log(np.diff(np.append(new, len(both))))) * self.idf[term]
        length = np.sqrt(np.bincount(text, weight**2, minlength=size))
        return text, term, weight / length[text]

    def candidates(
        self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, leave_out: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(text, example, cosine in single precision) of all that may be among a text's k examples of greatest cosine above 0, by text, and what ``nearest`` needs.

        ``leave_out`` names an example per text, or -1, that is not its own neighbour.
        """
        if not self._ready:
            self.prepare()
        place, blocks = self.place[term], self.width // self.block
        listed = np.flatnonzero(place < 0)
        weights, begin = weight[listed] * self.idf[term[listed]], self.first[term[listed]]
        n = self.first[term[listed] + 1] - begin
        start = np.concatenate([[0], np.cumsum(n)])
        edge = np.searchsorted(text[listed], np.arange(size + 1)).tolist()
        posting = start[edge].tolist()
        asked = np.zeros((size, self.exact.shape[1]))
        held = place >= 0
        asked[text[held], place[held]] = weight[held]
        single = asked[:, : self.n_common].astype(np.float32)
        by_row = np.flatnonzero(place >= self.n_common)
        rows, factors = place[by_row] - self.n_common, weight[by_row].astype(np.float32)
        row_edge = np.searchsorted(text[by_row], np.arange(size + 1)).tolist()
        taken = np.empty((max(b - a for a, b in zip(row_edge[:-1], row_edge[1:], strict=True)), self.width), np.float32)
        near, sums = np.zeros((size, self.width)), np.empty((size, self.width), np.float32)
        for lo in range(0, size, LISTED):  # a few texts at a time: what that takes stays in a core's cache
            hi = min(lo + LISTED, size)
            of, offset = slice(edge[lo], edge[hi]), posting[lo]
            at = np.repeat(begin[of] - start[of], n[of])
            at += np.arange(offset, posting[hi])
            found = self.postings.take(at, mode="clip")
            value = self.levels.take(found & ((1 << self.bits) - 1), mode="clip")
            value *= np.repeat(weights[of], n[of])
            found >>= self.bits
            for i in range(lo, hi):
                a, b = posting[i] - offset, posting[i + 1] - offset
                if a < b:
                    np.multiply(np.bincount(found[a:b], value[a:b], minlength=self.width), self.scale, out=near[i])
                sums[i] = near[i]
                a, b = row_edge[i], row_edge[i + 1]
                if a < b:
                    sums[i] += factors[a:b] @ self.rows.take(rows[a:b], 0, out=taken[: b - a], mode="clip")
        rough = np.ascontiguousarray(sums.reshape(size, blocks, self.block).transpose(1, 0, 2))  # a block's passages are one array
        bound = rough.max(2) + (single @ self.block_max).T
        shut = np.full(rough.shape, -1.0, np.float32)  # similarities in the blocks that were looked at
        k, first = min(self.k, self.width), min(2, blocks)
        most = np.argpartition(-bound, first - 1, axis=0)[:first]
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, most, True, axis=0)
        seen = np.zeros(blocks, bool)
        while True:
            here = (wanted & (bound > 0)).any(1) & ~seen
            for b in np.flatnonzero(here).tolist():  # for all passages: cheaper than for a copy of some
                np.matmul(single, self.dense[b], out=shut[b])
                shut[b] += rough[b]
            seen |= here
            if leave_out is not None:
                left = np.flatnonzero(leave_out >= 0)
                shut[leave_out[left] // self.block, left, leave_out[left] % self.block] = -1.0
            if first == 0 or seen.all():
                break
            looked = shut[most, np.arange(size)].transpose(1, 0, 2).reshape(size, -1)
            least = np.partition(looked, looked.shape[1] - k, axis=1)[:, looked.shape[1] - k] if looked.shape[1] >= k else np.zeros(size, np.float32)
            wanted, first = bound >= np.maximum(least, 0) - _ROUGH, 0
        # The k-th best is at least the k-th best of the blocks' own best; what reaches that is few.
        least = np.partition(shut.max(2), blocks - k, axis=0)[blocks - k] if blocks >= k else np.zeros(size, np.float32)
        spot = np.flatnonzero(shut >= np.maximum(least - _ROUGH, _ROUGH)[:, None])
        which, hit = spot // self.block % size, spot // (self.block * size) * self.block + spot % self.block
        found = shut.ravel()[spot]
        order = np.argsort(4.0 * which - found)
        which, hit, found = which[order], hit[order], found[order]
        edge = np.searchsorted(which, np.arange(size + 1))
        kth = np.minimum(edge[:-1] + k, edge[1:]) - 1
        enough = found >= np.where(np.diff(edge) > 0, found[np.maximum(kth, 0)] if len(found) else 0, 0)[which] - _ROUGH
        return which[enough], hit[enough], found[enough], (near, asked)

    def nearest(self, which: np.ndarray, hit: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k of these candidates of greatest cosine, for each text that has any; equal ones in index order."""
        near, asked = sums
        cosine, edge = near[which, hit], np.searchsorted(which, np.arange(len(near) + 1))
        for i in np.flatnonzero(np.diff(edge)).tolist():
            of = slice(edge[i], edge[i + 1])
            cosine[of] += self.exact[hit[of]] @ asked[i]
        cosine = np.round(cosine, 12)
        order = np.lexsort((hit, -cosine, which))
        which, hit, cosine = which[order], hit[order], cosine[order]
        first = np.arange(len(which)) - edge[which] < self.k
        return which[first], hit[first], cosine[first]

    def votes(self, which: np.ndarray, at: np.ndarray, cosine: np.ndarray, size: int) -> np.ndarray:
        """For each of ``size`` sets of neighbours the share of label 1, each weighing more the nearer it is; 0 for none. ``which`` is each neighbour's set."""
        near = self.weight[at] / (1.05 - np.minimum(cosine, 1))
        total = np.bincount(which, near, minlength=size)
        return np.bincount(which, near * self.label[at], minlength=size) / np.where(total > 0, total, 1)

    def most_toxic(self, texts: list[int], best: dict[int, tuple[float, np.ndarray]], text: np.ndarray, term: np.ndarray, weight: np.ndarray, leave_out: np.ndarray | None = None) -> None:
        """Put into ``best`` the vote and the neighbours of the passage with the highest vote of each text, the first of equal ones.

        ``texts`` names the text of each passage; ``text``, ``term`` and ``weight`` are the passages' terms. A vote that is
        clearly not its text's highest is not told exactly. Nor is one of neighbours with one label, 0 or 1 itself, that another passage had.
        """
        size = len(texts)
        which, hit, cosine, sums = self.candidates(text, term, weight, size, leave_out)
        rough = self.votes(which, hit, cosine, size).tolist()
        count, ones = np.bincount(which, minlength=size).tolist(), np.bincount(which, self.label[hit], minlength=size).tolist()
        top: dict[int, float] = {t: best[t][0] for t in texts if t in best}
        for i, t in enumerate(texts):
            if 0 < count[i] <= self.k:  # these are the neighbours, whatever their order
                top[t] = max(top.get(t, 0.0), rough[i])
        told, had = np.zeros(size, bool), {(t, best[t][0]) for t in texts if t in best}
        for i, t in enumerate(texts):
            if 0 < count[i] <= self.k:
                one_label = ones[i] in (0, count[i])
                told[i] = rough[i] >= top[t] - _CLOSE and not (one_label and (t, rough[i]) in had)
                if one_label:
                    had.add((t, rough[i]))
            else:
                told[i] = count[i] > 0
        chosen = told[which]
        which, hit, cosine = self.nearest(which[chosen], hit[chosen], sums)
        votes, edge = self.votes(which, hit, cosine, size).tolist(), np.searchsorted(which, np.arange(size + 1)).tolist()
        for i in np.flatnonzero(told).tolist():
            t = texts[i]
            if t not in best or votes[i] > best[t][0]:
                best[t] = votes[i], hit[edge[i] : edge[i + 1]]

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps))


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps closest to y over x, by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        pools.append([yi, wi, xi, xi])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in (p[0], p[0])])
    return xs, ys


def build(
    examples: list[tuple[int, int, np.ndarray, np.ndarray]], prefixes: tuple[int, ...], stands_for: dict[int, float], k: int, passage: int, block: int, common_share: float
) -> Examples:
    """An index of (id, label, hashes, occurrences), each standing for so many rows of its label; not calibrated yet.

    A term's idf is ln((1 + rows) / (1 + rows with it)) + 1 over the rows that the examples stand for.
    """
    labels = np.array([e[1] for e in examples])
    weight = np.array([stands_for[x] for x in labels.tolist()])
    owner = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
    hashed, n = (np.concatenate([*(e[i] for e in examples), np.zeros(0, kind)]) for i, kind in ((2, np.uint64), (3, np.int64)))
    keys, term = np.unique(hashed, return_inverse=True)
    idf = np.log((1 + weight.sum()) / (1 + np.bincount(term, weight[owner], minlength=len(keys)))) + 1
    value = (1 + np.log(n)) * idf[term]
    length = np.sqrt(np.bincount(owner, value**2, minlength=len(examples)))
    value = value / length[owner]
    # Alike examples share a block: by label and strongest term.
    strong = np.full(len(examples), -1)
    order = np.argsort(value, kind="stable")
    strong[owner[order]] = term[order]  # the last one written is the greatest
    empty = strong < 0
    prior = (weight * labels).sum() / weight.sum()
    listed = [i for i in sorted(range(len(examples)), key=lambda i: (labels[i], strong[i], examples[i][0])) if not empty[i]]
    number = np.full(len(examples), -1)
    number[listed] = np.arange(len(listed))
    order = np.lexsort((number[owner], term))
    first = np.searchsorted(term[order], np.arange(len(keys) + 1))
    ids = np.array([e[0] for e in examples], np.int64)
    occurring, level = np.unique(n, return_inverse=True)
    column, level = (x[order].astype(np.min_scalar_type(size)) for x, size in ((number[owner], len(listed)), (level, len(occurring))))
    return Examples(
        prefixes, HashTable.of(keys, np.arange(len(keys))), idf, ids[listed], labels[listed], weight[listed],
        first, column, level, 1 + np.log(occurring), length[listed], k, passage, block, max(2, int(common_share * len(listed))),
        float(((weight * labels)[empty].sum() + prior) / (weight[empty].sum() + 1)), (np.array([0.0, 1.0]), np.array([prior, prior])),
    )


@dataclass
class Toxicity:
    """The index, or without examples of both classes the score of every text."""

    examples: Examples | None
    constant: float


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = 2000, prefixes: tuple[int, ...] = (4,), k: int = 15, passage: int = 48, block: int = 64, common_share: float = 0.2
) -> Toxicity:
    """Index documents (doc_id, text) with labels (doc_id, label of 0 or 1).

    About ``per_class`` labelled ids of each class are drawn by a hash: the bound on the index and on what reaches the
    driver, where the terms of their whole texts come. Their votes count as the rows they stand for. A document labelled both ways counts as 1; an
    id with several texts teaches one of them, the least by hash. Calibration searches the examples in tasks. Eager.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    constant = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    if len(n) < 2:
        return Toxicity(None, constant)
    sample, _ = sampled_by_class(known, "label", per_class, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    # The sample has a bound, so it may be sent to all tasks; the documents are not shuffled, and of copies of an id one text is.
    same = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    drawn = settle(same, "examples")
    of = {r[0]: r[1] for r in drawn.groupBy("label").count().collect()}
    if len(of) < 2:
        return Toxicity(None, constant)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = [_clean(t) for t in texts_of(batch, "text")]
            for lo, hi in pieces(cleaned):
                words = split(cleaned, lo, hi)
                text, hashed, count = term_counts(words, prefixes, words.text_of())
                edge = np.searchsorted(text, np.arange(hi - lo + 1))
                parts = [[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for x in (hashed, count.astype(np.int64))]
                ids = [batch.column(x).slice(lo, hi - lo) for x in ("doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(p, pa.binary()) for p in parts)], ["doc_id", "label", "hashes", "counts"])

    found = drawn.select("doc_id", F.col("label").cast("long"), "text").mapInArrow(extract, "doc_id long, label long, hashes binary, counts binary")
    rows = [(i, y, np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)) for i, y, h, c in sorted(map(tuple, found.collect()))]
    index = build(rows, prefixes, {x: n[x] / of[x] for x in (0, 1)}, k, passage, block, common_share)
    del rows
    votes = _votes(drawn, index)
    discard(drawn)
    if votes:
        place = {i: p for p, i in enumerate(index.ids.tolist())}
        at = np.array([place[i] for i, _ in votes])
        index = replace(index, steps=_isotonic(np.array([v for _, v in votes]), index.label[at].astype(float), index.weight[at]))
    return Toxicity(index, constant)


def _votes(drawn: DataFrame, index: Examples) -> list[tuple[int, float]]:
    """(id, vote of the other examples) of every example that has neighbours: one number per example of the bounded sample."""
    sent = broadcast_value(drawn.sparkSession, index)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {i: p for p, i in enumerate(sent.value.ids.tolist())}
        for batch in batches:
            own = [place.get(i, -1) for i in batch.column("doc_id").to_pylist()]
            found = [(i, vote) for i, vote, _ in _searched(sent.value, batch, own)]
            ids = batch.column("doc_id").take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([v for _, v in found], pa.float64())], ["doc_id", "vote"])

    return sorted(map(tuple, drawn.select("doc_id", "text").mapInArrow(vote, "doc_id long, vote double").collect()))


def _searched(index: Examples, batch: pa.RecordBatch, own: list[int] | None = None) -> Iterator[tuple[int, float, np.ndarray]]:
    """(row of the batch, vote, neighbours) of every text with a passage that has neighbours: of the one with the highest vote, the first of equal ones."""
    texts = [_clean(t) for t in texts_of(batch, "text")]
    for lo, hi in pieces(texts):
        words = split(texts, lo, hi)
        passage, text = passages(words, index.passage)
        best: dict[int, tuple[float, np.ndarray]] = {}
        owner, term, weight = index.vectors(words, passage, len(text))
        for a in range(0, len(text), TOGETHER):
            b = min(a + TOGETHER, len(text))
            of = slice(*np.searchsorted(owner, [a, b]))
            leave_out = None if own is None else np.array([own[lo + t] for t in text[a:b].tolist()])
            index.most_toxic(text[a:b].tolist(), best, owner[of] - a, term[of], weight[of], leave_out)
        yield from ((lo + t, vote, at) for t, (vote, at) in best.items())


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score (probability of label 1), neighbours and evidence, one row per row of ``docs``.

    ``neighbours`` are the doc_ids of the examples nearest to the passage with the highest vote, nearest first; ``evidence`` those of them with the label that the
    score speaks for. A text without any term of the index, such as a null or empty one, has the score of the examples without any. Rows that repeat are
    scored one by one, other columns are not read; no label, language or source has a part. Texts are read whole.
    """
    sent = broadcast_for_workers(docs.sparkSession, model)  # the index is made ready once a worker

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.examples
        for batch in batches:
            scores = np.full(batch.num_rows, index.empty_score if index else sent.value.constant)
            evidence, neighbours = ([[] for _ in range(batch.num_rows)] for _ in range(2))
            for i, vote, found in _searched(index, batch) if index else ():
                scores[i] = index.calibrated(vote)
                neighbours[i] = index.ids[found].tolist()
                evidence[i] = index.ids[found[index.label[found] == int(scores[i] >= 0.5)]].tolist()
            columns = [batch.column("doc_id"), pa.array(scores), *(pa.array(x, pa.list_(pa.int64())) for x in (evidence, neighbours))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence", "neighbours"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, evidence array<long>, neighbours array<long>")
