"""Names of persons by a learned sequence tagger, for names that no form of address announces.

The texts teach it themselves: words after a form of address are names, and such a word is one wherever else it stands. What the
tagger learns from these places are shapes and contexts, which hold for names it has never seen. It is a
perceptron over tag sequences, decoded by Viterbi's algorithm. Every task trains on its own rows, the weights are averaged over the
tasks by their rows, and the next pass starts from there (iterative parameter mixing, McDonald, Hall and Mann, 2010).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle
from .logistic import tree_sum

# The forms of address after which a name stands, and the two tags.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof")
OUTSIDE, NAME = 0, 1

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_")
#: Tokens that are tagged together; sentences end at . ! ? or a line's end, and a longer stretch is cut.
MOST_TOKENS = 200


def tokens_of(text: str) -> list[list[tuple[int, int, str]]]:
    """Sentences of (start, end, token)."""
    sentences: list[list[tuple[int, int, str]]] = [[]]
    last = 0
    for m in _TOKEN.finditer(text):
        ended = sentences[-1] and sentences[-1][-1][2] in ".!?" and not _abbreviated(sentences[-1])
        if sentences[-1] and (ended or "\n" in text[last : m.start()] or len(sentences[-1]) >= MOST_TOKENS):
            sentences.append([])
        sentences[-1].append((m.start(), m.end(), m.group()))
        last = m.end()
    return [s for s in sentences if s]


def _abbreviated(sentence: list[tuple[int, int, str]]) -> bool:
    return len(sentence) > 1 and sentence[-1][2] == "." and sentence[-2][2] in TITLES


def is_capitalised(token: str) -> bool:
    return token[:1].isupper() and len(token) > 1 and not token.isupper()


def titled_names(sentence: Sequence[str]) -> list[int]:
    """Places of up to three capitalised words after a form of address."""
    found = []
    for i, token in enumerate(sentence):
        if token in TITLES:
            at = i + 1 + (sentence[i + 1 : i + 2] == ["."])
            end = at
            while end < min(len(sentence), at + 3) and is_capitalised(sentence[end]):
                end += 1
            found += range(at, end)
    return found


def _shape(token: str) -> str:
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in token]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


def features_of(sentence: Sequence[str], buckets: int) -> list[list[int]]:
    """Hashed features of each token: its shape and ending, and the words and shapes around it. Never the whole word, nor whether a title stands there."""
    words = ["<"] + ["." if t in TITLES else t.lower() for t in sentence] + [">"]
    shapes = ["<"] + [_shape(t) for t in sentence] + [">"]
    out = []
    for i in range(1, len(words) - 1):
        before = words[i - 1] if words[i - 1] != "." else "<."
        named = (f"s{shapes[i]}", f"e{words[i][-2:]}", f"p{before}", f"n{words[i + 1]}", f"q{shapes[i - 1]}{shapes[i]}", f"r{shapes[i]}{shapes[i + 1]}", f"b{before}|{shapes[i]}", f"a{words[i + 1]}|{shapes[i]}", f"l{min(len(words[i]), 9)}")
        out.append([zlib.crc32(f.encode()) % buckets for f in named])
    return out


def viterbi(emit: np.ndarray, step: np.ndarray) -> list[int]:
    """The tags of the highest sum of emit[i, tag] and step[tag before, tag]; the smaller tag of equal ones."""
    score, back = emit[0], []
    for row in emit[1:]:
        ways = score[:, None] + step
        best = ways.argmax(axis=0)
        back.append(best)
        score = ways[best, np.arange(len(row))] + row
    tags = [int(score.argmax())]
    for best in reversed(back):
        tags.append(int(best[tags[-1]]))
    return tags[::-1]


@dataclass(frozen=True)
class NameTagger:
    """Weights by bucket and tag, and by tag and tag before."""

    weights: np.ndarray = field(repr=False)  # (buckets + 2, 2): the last two rows are the steps

    def tags(self, sentence: Sequence[str]) -> list[int]:
        return _decode(features_of(sentence, len(self.weights) - 2), self.weights)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each name; neighbouring name words are one name, also where a hyphen or nothing but blanks is between."""
        found: list[tuple[int, int]] = []
        for sentence in tokens_of(text):
            if not any(is_capitalised(t) for _, _, t in sentence):
                continue
            last = -2
            for i, tag in enumerate(self.tags([t for _, _, t in sentence])):
                start, end, token = sentence[i]
                if tag == NAME and is_capitalised(token):
                    if last == i - 1:
                        found[-1] = (found[-1][0], end)
                    else:
                        found.append((start, end))
                    last = i
        return found

    def __call__(self, text: Column, label: str = "[NAME]") -> Column:
        """``text`` with its names replaced. In Arrow batches; NULL stays NULL."""

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([None if t is None else _without(t, self.spans(t), label) for t in batch.to_pylist()], pa.string())

        return F.arrow_udf(run, "string")(text)


def _without(text: str, spans: list[tuple[int, int]], label: str) -> str:
    parts, last = [], 0
    for start, end in spans:
        parts += [text[last:start], label]
        last = end
    return "".join([*parts, text[last:]])


def _decode(features: list[list[int]], weights: np.ndarray) -> list[int]:
    return viterbi(weights[np.array(features)].sum(axis=1), weights[-2:])


def _add(weights: np.ndarray, features: list[list[int]], tags: Sequence[int], by: float) -> None:
    np.add.at(weights, (np.array(features), np.array(tags)[:, None]), by)
    for a, b in zip(tags, tags[1:], strict=False):
        weights[len(weights) - 2 + a, b] += by


def _pass(table: DataFrame, weights: np.ndarray) -> DataFrame:
    """One perceptron pass of every task over its sentences: the sum over its steps of the weights, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, late, steps = weights.copy(), np.zeros_like(weights), 0
        for batch in batches:
            for tokens, tags in zip(batch.column("tokens").to_pylist(), batch.column("tags").to_pylist(), strict=True):
                features = features_of(tokens, len(weights) - 2)
                found = _decode(features, now)
                if found != tags:
                    _add(now, features, tags, 1.0)
                    _add(now, features, found, -1.0)
                    _add(late, features, tags, float(steps))  # the steps that had passed without this change
                    _add(late, features, found, -float(steps))
                steps += 1
        if steps:
            summed = (now * steps - late).ravel()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.append(summed, steps).tobytes()], pa.binary())], ["part", "gradient"])

    return table.mapInArrow(run, "part long, gradient binary")


def _taught_sentences(texts: Iterator[str | None]) -> Iterator[tuple[list[str], list[str]]]:
    for text in texts:
        for sentence in tokens_of(text or ""):
            words = [t for _, _, t in sentence]
            yield words, [words[i] for i in titled_names(words)]


def fit_names(df: DataFrame, text_col: str, passes: int = 5, buckets: int = 1 << 14, least_times: int = 2) -> NameTagger:
    """A tagger bootstrapped from the forms of address in the texts.

    A word that stands after a form of address ``least_times`` or more, and there more often than elsewhere in lower case, is a known name;
    sentences with one, and sentences with another capitalised word beyond their first, are learned from. Without any known name
    the tagger finds none. Eager: sentences are written; a pass sends back one vector of weights per task, which a tree adds up.
    """
    shapes = "tokens array<string>, titled array<string>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_taught_sentences(iter(batch.column(0).to_pylist())))
            rows = [r for r in rows if r[1] or any(map(is_capitalised, r[0][1:]))]
            columns = [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["tokens", "titled"])

    sentences = settle(df.select(F.col(text_col).cast("string")).mapInArrow(split, shapes), "sentences")
    titled = sentences.select(F.explode("titled").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)
    common = sentences.select(F.explode("tokens").alias("low")).where("low = lower(low)").groupBy("low").agg(F.count("*").alias("m"))
    known = titled.join(common, F.lower("word") == F.col("low"), "left").where("m is null or m < n").select("word")
    numbered = sentences.select("tokens", F.monotonically_increasing_id().alias("number"))
    hits = numbered.select("number", F.posexplode("tokens").alias("i", "word")).join(known, "word").groupBy("number").agg(F.collect_set("i").alias("at"))
    tagged = numbered.join(hits, "number", "left").select(
        "tokens", F.transform("tokens", lambda t, i: F.coalesce(F.array_contains("at", i), F.lit(False)).cast("int")).alias("tags")
    )
    table = settle(tagged.sortWithinPartitions(F.xxhash64("tokens")), "tagged-sentences")
    weights = average = np.zeros((buckets + 2, 2))
    if not known.isEmpty():
        tasks = table.rdd.getNumPartitions()
        for _ in range(passes):
            summed = tree_sum(_pass(table, weights), tasks)
            weights = summed[:-1].reshape(weights.shape) / summed[-1]
            average = average + weights
    discard(sentences, table)
    return NameTagger(average / passes)
