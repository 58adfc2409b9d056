"""Token counts of texts at every prefix, for a byte-fallback BPE model of ``sentencepiece``.

BPE merges the best pair first, so what stands left of a token never depends on what
follows it: the encoding of a prefix is that of a shorter prefix and one last token.
A dynamic program over the prefixes finds the last token of each: of the pieces that
end there, the one that the last token of the prefix before it leaves alone, which is to say
that BPE over the two alone gives back the two. Exactly one does. Its count is one more than
that of the prefix before it. So one pass gives the exact count of *every* prefix, and
questions of truncation and budget are look-ups in a stored array.

A piece never has the space mark after another character (checked when the model is read), so no token
crosses the place where a space follows anything else. The text falls into stretches there,
and a stretch that is met again is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import broadcast_for_workers

_SPACE = "▁"
_NONE = float("-inf")
_LONG = 64  # characters of the longest stretch that is remembered
_PROBES = ("a b", " a  ", "ﬁ①Ａ\u3000é", "\t\r\n\ufeff\u200b", "e\u0301")  # normalizers change some of these


class _Bounded(dict):
    """A cache that is emptied when it holds ``limit`` entries; none is of a long key."""

    def __init__(self, fill: Callable, limit: int):
        self.fill, self.limit = fill, limit

    def __missing__(self, key):
        value = self.fill(key)
        if not isinstance(key, str) or len(key) <= _LONG:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class PrefixCounter:
    """Exact token counts at every prefix, as ``sentencepiece`` encodes with its defaults."""

    def __init__(self, model: str, cached: int = 400_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.vocab_size())
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        inner = any(_SPACE in p.lstrip(_SPACE) for p in self.score)
        loose = any(c not in self.score for p in self.score for c in p)
        plain = all(sp.normalize(t) == _SPACE + t.replace(" ", _SPACE) for t in _PROBES)
        if inner or loose or not plain or not any(map(sp.is_byte, ids)) or any(map(sp.is_unused, ids)):
            raise ValueError("not a byte-fallback BPE of unchanged texts whose pieces begin at spaces")
        self.model, self.cached = model, cached
        loners = "".join(c for c in "\n\r\t" if c not in self.score)  # in no piece: nothing crosses them either
        alone = f"[{loners}]|" if loners else ""
        self.split = re.compile(f"{alone}{_SPACE}*[^{_SPACE}{loners}]+|{_SPACE}+").findall
        self.names = list(self.score)
        self.pieces = ahocorasick.Automaton()
        for number, piece in enumerate(self.names):
            self.pieces.add_word(piece, (len(piece), number))
        self.pieces.make_automaton()
        self.merges: dict[int, tuple] = {}
        self.apart = _Bounded(self._stay_apart, 2_000_000)
        self.stretches = _Bounded(lambda stretch: np.array(self._counts(stretch), np.int32), cached // 8)
        self.totals = _Bounded(lambda stretch: self._counts(stretch)[-1], cached)

    def __reduce__(self):
        return PrefixCounter, (self.model, self.cached)

    def _parts(self, text: str) -> list[str]:
        return self.split(_SPACE + text.replace(" ", _SPACE))

    def _merged(self, number: int) -> tuple[list, list, list, bool]:
        """What BPE does with one piece alone: each merge's score, the last and first part before each merge and at the end, and whether the piece comes out."""
        if number not in self.merges:
            parts = list(self.names[number])
            best, last, first = [], [parts[-1]], [parts[0]]
            while len(parts) > 1:
                scores = [self.score.get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
                best.append(max(scores))
                if best[-1] == _NONE:
                    break
                at = scores.index(best[-1])  # the left one of equals
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                last.append(parts[-1])
                first.append(parts[0])
            self.merges[number] = [*best, _NONE], last, first, len(parts) == 1
        return self.merges[number]

    def _stay_apart(self, pair: int) -> bool:
        """Whether BPE over two pieces gives back the two: no merge across their border is ever the best one.

        Until one is, each piece's own merges come in the order they have in the piece alone. Of equal scores the left merge
        comes first. A pair with the number of no piece in front tells whether the second comes out of the merging at all.
        """
        left, right = divmod(pair, len(self.names) + 1)
        right_best, _, right_first, whole = self._merged(right)
        if left == len(self.names) or not whole:
            return whole
        left_best, left_last, _, _ = self._merged(left)
        i = j = 0
        while True:
            across = self.score.get(left_last[i] + right_first[j], _NONE)
            if across > left_best[i] and across >= right_best[j]:
                return False
            if left_best[i] == right_best[j] == _NONE:
                return True
            if left_best[i] >= right_best[j]:
                i += 1
            else:
                j += 1

    def _counts(self, stretch: str) -> list[int]:
        """Counts at the first 1, 2, ... characters of a stretch."""
        n, apart, other = len(stretch), self.apart, len(self.names) + 1
        none = other * other - other  # no piece in front
        count = [-1] * n + [0]  # the entry behind the end, at -1, is the empty prefix
        last = [none] * (n + 1)  # the last piece's number, times ``other``
        for end, (length, piece) in self.pieces.iter(stretch):
            if count[end] < 0:
                start = end - length
                if count[start] < 0:
                    _fill_unknown(stretch, count, start)
                if apart[last[start] + piece]:
                    count[end] = count[start] + 1
                    last[end] = piece * other
        if count[n - 1] < 0:
            _fill_unknown(stretch, count, n - 1)
        count.pop()
        return count

    def total(self, text: str) -> int:
        """Tokens of the whole text: the count at its last prefix."""
        return sum(map(self.totals.__getitem__, self._parts(text))) if text else 0

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, 2, ... characters."""
        if not text:
            return np.zeros(1, np.int32)
        parts = [self.stretches[stretch] for stretch in self._parts(text)]
        before = np.cumsum([0] + [part[-1] for part in parts[:-1]])
        counts = np.concatenate([part + b for part, b in zip(parts, before, strict=True)]).astype(np.int32)
        counts[0] = 0  # the mark that the model puts before a text
        return counts


def _fill_unknown(stretch: str, count: list[int], end: int) -> None:
    """Counts up to ``end`` of characters that are in no piece: nothing merges with them, and each UTF-8 byte is a token."""
    start = end
    while start >= 0 and count[start] < 0:
        start -= 1
    for i in range(start + 1, end + 1):
        count[i] = count[i - 1] + len(stretch[i].encode())


def token_counts(docs: DataFrame, model: str, text: str = "text", prefixes: bool = False) -> DataFrame:
    """``docs`` with n_tokens, and with ``prefixes`` also prefix_tokens: counts of the first 0, 1, ... characters.

    ``model`` is the path of a model file that every executor has. A null or empty text has no
    tokens; whole texts are counted, however long. Rows that repeat are counted one by one, and all other columns stay
    as they are; a column that has one of the new names already is an error, not overwritten.
    """
    new = ["n_tokens"] + ["prefix_tokens"] * prefixes
    taken = {c.lower() for c in docs.columns} & set(new)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")

    sent = broadcast_for_workers(docs.sparkSession, PrefixCounter(model))

    def totals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sent.value.total(t) for t in _texts(batch)], pa.int64())

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sent.value.prefixes(t) for t in _texts(batch)], pa.list_(pa.int32()))

    value = F.col(text).cast("string").cast("binary")
    if not prefixes:
        return docs.withColumn("n_tokens", F.arrow_udf(totals, "long").asNondeterministic()(value))
    table = docs.withColumn("prefix_tokens", F.arrow_udf(counted, "array<int>").asNondeterministic()(value))
    return table.withColumn("n_tokens", F.element_at("prefix_tokens", -1).cast("long"))


def _texts(batch: pa.Array) -> list[str]:
    return [(t or b"").decode(errors="replace") for t in batch.to_pylist()]


def tokens_before(position: Column | int, counts: str = "prefix_tokens") -> Column:
    """Tokens of the first ``position`` characters, read from stored counts; of the whole text where it is shorter."""
    at = F.least(F.greatest(F.lit(position) if isinstance(position, int) else position, F.lit(0)), F.size(counts) - 1)
    return F.element_at(counts, at.cast("int") + 1).cast("long")


def longest_within(budget: int, counts: str = "prefix_tokens") -> Column:
    """The most characters whose encoding has at most ``budget`` tokens, read from stored counts.

    Counts may fall as a prefix grows, so it is the last fitting prefix, not the one before the first that is too long.
    """
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i).otherwise(-1))
    return F.array_max(fits).cast("long")


def truncated(budget: int, text: str = "text", counts: str = "prefix_tokens") -> Column:
    """The longest beginning of the text that has at most ``budget`` tokens."""
    return F.substring(F.col(text), F.lit(1), longest_within(budget, counts).cast("int"))
