"""Words of many texts at once, as numpy arrays, inside Arrow batches.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. It is named by a
64-bit hash of its bytes, equal in every task and session, so that shuffles
carry eight bytes whatever the word's length: the sum of a random-looking number for each
byte at its place in the word. Sequences of words are hashed as a tree of pairs, each
pair mixed. Neither is linear in the bytes or words, so that regular texts, such as Thue-Morse
sequences, meet no more often than others: two different ones with a probability of about 2**-64.

N-grams of characters, which are short, have a polynomial hash: with prefix sums of byte * BASE**position,
that of any stretch of bytes costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20

# Odd multipliers (any odd numbers do; all tasks must use the same).
_BYTE_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xD1342543DE82EF95)
_LEFT = np.uint64(0xA0761D6478BD642F)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_AS_SPACE = np.where(_SPACE, 0x20, np.arange(256)).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    """``n`` fixed 64-bit numbers that look random."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(_BYTE_BASE))


_BYTE_VALUE = seeds(256)


class _Powers:
    """base**i and base**-i modulo 2**64, extended when a longer text comes."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, (self.base,)  # functions that are sent to tasks don't carry the tables

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK)
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, np.uint64))])
                for b in (self.base, inverse)
            )
        return self.up, self.down


_byte_powers = _Powers(_BYTE_BASE)


def byte_prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a byte array, and the factors that ``span_hash`` needs."""
    up, down = _byte_powers.to(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=prefix[1:])
    return prefix, down


def span_hash(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words of these sizes, whose bytes follow each other in ``data``."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(begin, sizes)
    each = mix(_BYTE_VALUE[data] + place.astype(np.uint64) * _PLACE)
    return mix(np.add.reduceat(each, begin) + sizes.astype(np.uint64))


def word_hash(word: bytes) -> int:
    """The hash of one word, as ``Words`` has it."""
    return int(word_hashes(np.frombuffer(word, np.uint8), np.array([len(word)]))[0])


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + right)


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; element i starts at word i.

    Sequences that run over the end of a text are included: the caller leaves
    them out by the words' ranges.
    """
    m = len(hashes) - k + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    out, have, power, size = np.full(m, k, np.uint64), 0, hashes, 1
    while have < k:
        if k & size:
            out = _pair(out, power[have : have + m])
            have += size
        if have < k:
            power = _pair(power[:-size], power[size:])
            size *= 2
    return out


def stretch_hashes(hashes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of ``length`` words from ``begin`` on, each stretch of its own length; as ``sequence_hashes`` has it."""
    out, at, power, size = length.astype(np.uint64), begin.copy(), hashes, 1
    longest = int(length.max(initial=0))
    while size <= longest:
        odd = np.flatnonzero(length & size)
        out[odd] = _pair(out[odd], power[at[odd]])
        at[odd] += size
        power = _pair(power[:-size], power[size:])
        size *= 2
    return out


@dataclass
class Words:
    """The words of the texts ``lo`` to ``hi`` of a batch."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of the texts, a space before and after each
    start: np.ndarray  # of each word in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per text: number of its first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Per word: which text, counted from ``lo``."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def pieces(texts: list[bytes | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; all texts are covered."""
    lo = total = 0
    for i, text in enumerate(texts):
        total += len(text or b"")
        if total >= size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with a space around each; where each begins, and the end."""
    blob = b"".join([b" ", *(x for t in texts for x in (t or b"", b" "))])
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(blob, np.uint8), np.concatenate([[1], 1 + np.cumsum(lengths)])


def split(texts: list[bytes | None], lo: int, hi: int, lower: bool = False) -> Words:
    data, begin = joined(texts[lo:hi])
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space))  # a word lies between each two edges
    start, end = edge[0::2] + 1, edge[1::2] + 1
    return Words(lo, hi, data, start, end, word_hashes(data[~space], end - start), np.searchsorted(start, begin))


def chunks(batch: pa.RecordBatch, column: str, lower: bool = False, size: int = CHUNK) -> Iterator[Words]:
    """The words of a batch's texts, some texts at a time. Null is an empty text."""
    texts = texts_of(batch, column)
    for lo, hi in pieces(texts, size):
        yield split(texts, lo, hi, lower)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


def char_grams(words: Words, n: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the words' n-grams of characters, the space on either side of a word included.

    With ``wanted`` (per word), only of those words.
    """
    char = np.flatnonzero((words.data & 0xC0) != 0x80)  # first bytes of characters
    if len(char) <= n or not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = np.zeros(len(words.data), np.int32)
    begins[words.start] = 1
    word = (np.cumsum(begins, dtype=np.int32) - 1)[char]
    space = _SPACE[words.data[char]]
    gaps = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    m = len(char) - n
    good = gaps[max(n - 1, 1) : max(n - 1, 1) + m] == gaps[min(1, n - 1) : min(1, n - 1) + m]  # no space inside
    if n == 1:
        good = ~space[:m]
    owner = np.where(space[:m], word[1 : m + 1], word[:m])
    good &= owner >= 0
    if wanted is not None:
        good &= wanted[owner]
    at = np.flatnonzero(good)
    prefix, down = byte_prefix(_AS_SPACE[words.data])
    return owner[at], span_hash(prefix, down, char[at], char[at + n])


def char_prefixes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash of its first n characters) of the words that have more than n."""
    char = np.flatnonzero((words.data & 0xC0) != 0x80)
    first = np.searchsorted(char, words.start)
    last = np.minimum(first + n, len(char) - 1)
    owner = np.flatnonzero(char[last] < words.end) if len(char) else np.zeros(0, np.int64)
    prefix, down = byte_prefix(words.data)
    return owner, span_hash(prefix, down, words.start[owner], char[last[owner]])
