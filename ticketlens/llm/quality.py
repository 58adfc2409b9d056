"""Quality classifier: supervised subword embeddings.

Each word, and each of its character n-grams, is hashed to a bucket that has a learned
vector. A document is the mean of its vectors, a softmax over the mean gives the
classes, and both layers are trained together by stochastic gradient descent (Joulin et al.,
"Bag of Tricks for Efficient Text Classification", 2016). A word that repeats the one before it
adds one more feature, the same for all words.

As the output is linear in the mean, a trained model of two classes is one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import broadcast_value, sampled_by_class
from .words import Words, char_grams, chunks, mix, texts_of, pieces, split


@dataclass(frozen=True)
class Features:
    """Word and n-gram features, hashed to 2**bits buckets."""

    bits: int = 18
    grams: tuple[int, ...] = (3, 4)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every feature occurrence."""
        text = words.text_of()
        owners, hashes = [np.arange(len(text))], [words.hash]
        again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])) + 1
        owners.append(again)
        hashes.append(np.full(len(again), 1, np.uint64))
        for n in self.grams:
            owner, h = char_grams(words, n)
            owners.append(owner)
            hashes.append(mix(h + np.uint64(n)))
        owner = np.concatenate(owners)
        return text[owner], (np.concatenate(hashes) >> np.uint64(64 - self.bits)).astype(np.int64)


@dataclass
class Quality:
    """The trained model: what each bucket adds to the logit of class 1, and the constant."""

    features: Features
    weight: np.ndarray
    bias: float


def train(
    buckets: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, size: int, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 5
) -> np.ndarray:
    """Stochastic gradient descent over documents; per bucket, class 1's logit minus class 0's."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim))
    output = np.zeros((2, dim))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            step = rate * (1 - done / steps)
            done += 1
            if not len(buckets[i]):
                continue
            share = (counts[i] / counts[i].sum())[:, None]
            mean = (vectors[buckets[i]] * share).sum(0)
            logits = output @ mean
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1  # the gradient of the loss
            back = p @ output
            output -= step * np.outer(p, mean)
            vectors[buckets[i]] -= step * len(buckets[i]) ** 0.5 * share * back
    return vectors @ (output[1] - output[0])


def fit_quality(docs: DataFrame, labels: DataFrame, features: Features = Features(), per_class: int = 2000, **training) -> Quality:
    """Learn from documents (doc_id, text) with labels (doc_id, label of 0 or 1).

    About ``per_class`` labelled rows of each class are used, drawn by a hash of their
    doc_id: the bound on what reaches the driver. The share of each class in all labels
    sets the constant. A document labelled both ways counts as 1. Rows with a null id or label,
    and a null text, teach nothing; with no label, or of one class only, every score is that share. Eager.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    constant = Quality(features, np.zeros(1 << features.bits), float(np.log(share / (1 - share))))
    if len(n) < 2:
        return constant
    sample, _ = sampled_by_class(known, "label", per_class, "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            texts = texts_of(batch, "text")
            for lo, hi in pieces(texts):
                text, bucket = features.of(split(texts, lo, hi))
                keys, number = np.unique((text << features.bits) + bucket, return_counts=True)
                edge = np.searchsorted(keys >> features.bits, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    of = slice(edge[i], edge[i + 1])
                    own, count = keys[of] & ((1 << features.bits) - 1), number[of]
                    row = [[labels[lo + i]], [own.astype(np.int32).tobytes()], [np.minimum(count, 65535).astype(np.uint16).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["label", "buckets", "counts"])

    # The sample has a bound, so it may be sent to all tasks; the documents are not shuffled.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = texts.join(F.broadcast(sample), "doc_id").mapInArrow(extract, "label long, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["buckets"])))  # the order of tasks must not matter
    truth = np.array([r["label"] for r in rows], np.int64)
    if len(set(truth.tolist())) < 2:
        return constant
    buckets = [np.frombuffer(r["buckets"], np.int32) for r in rows]
    counts = [np.frombuffer(r["counts"], np.uint16).astype(np.float64) for r in rows]
    weight = train(buckets, counts, truth, 1 << features.bits, **training)
    drawn = truth.mean()  # the sample has another share of class 1 than the labels
    return Quality(features, weight, float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))))


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id and score, the probability of class 1; a null or empty text has the constant's."""
    sent = broadcast_value(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            ids = batch.column("doc_id")
            for words in chunks(batch, "text"):
                text, bucket = model.features.of(words)
                size = words.hi - words.lo
                number = np.bincount(text, minlength=size)
                logit = np.bincount(text, model.weight[bucket], minlength=size) / np.maximum(number, 1) + model.bias
                yield pa.RecordBatch.from_arrays([ids.slice(words.lo, size), pa.array(1 / (1 + np.exp(-logit)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")
