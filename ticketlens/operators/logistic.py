"""Logistic regression on hashed words, by gradients that tasks sum up and a tree combines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_LETTERS
from ..session import discard, settle
from .embedding import text_slices

FEATURES = "struct<buckets:array<int>,values:array<double>>"


def _sparse(texts: pa.Array, dim: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, buckets, values): word counts by bucket, each row scaled to length 1, in the order of rows and buckets."""
    words = pc.split_pattern_regex(texts.fill_null(""), NOT_LETTERS)
    rows = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    if len(known) > 500_000:
        known.clear()
    codes = np.empty(len(coded.dictionary), np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        if word not in known:
            known[word] = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim if word else -1
        codes[i] = known[word]
    places = codes[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    cells, counts = np.unique((rows * dim + places)[places >= 0], return_counts=True)
    rows, buckets = np.divmod(cells, dim)
    lengths = np.sqrt(np.bincount(rows, counts.astype(np.float64) ** 2, minlength=len(texts)))
    return rows, buckets, counts / lengths[rows]


def hashed_features(text: Column, dim: int) -> Column:
    """A text's words in ``dim`` buckets, only those it has; none for NULL or a text without a letter."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in batches:
            done = []
            for part in text_slices(batch):
                rows, buckets, values = _sparse(part, dim, known)
                ends = pa.array(np.searchsorted(rows, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (buckets.astype(np.int32), values)]
                done.append(pa.StructArray.from_arrays(lists, ["buckets", "values"]))
            yield pa.concat_arrays(done)

    return F.arrow_udf(run, FEATURES)(F.lower(text))


@dataclass(frozen=True)
class LogisticModel:
    """One weight per bucket, and the constant behind them."""

    weights: np.ndarray = field(repr=False)

    @property
    def dim(self) -> int:
        return len(self.weights) - 1

    def __call__(self, text: Column) -> Column:
        """The probability of label 1, at equal shares of both labels if the model was fitted balanced. A text without a word has the constant's."""
        weights = self.weights

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, int] = {}
            for batch in batches:
                done = []
                for part in text_slices(batch):
                    rows, buckets, values = _sparse(part, len(weights) - 1, known)
                    logit = np.bincount(rows, weights[buckets] * values, minlength=len(part)) + weights[-1]
                    done.append(pa.array(1 / (1 + np.exp(-logit))))
                yield pa.concat_arrays(done)

        return F.arrow_udf(run, "double")(F.lower(text))


def _gradients(table: DataFrame, weights: np.ndarray, importance: dict[int, float]) -> DataFrame:
    """One row per task that has rows: its number and its sum of weighted gradients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(len(weights)), False
        for batch in batches:
            any_row = any_row or batch.num_rows > 0
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = pc.list_value_length(batch.column("buckets")).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            buckets = batch.column("buckets").flatten().to_numpy()
            values = batch.column("values").flatten().to_numpy()
            logit = np.bincount(rows, weights[buckets] * values, minlength=batch.num_rows) + weights[-1]
            error = (1 / (1 + np.exp(-logit)) - label) * np.where(label == 1, importance[1], importance[0])
            total[:-1] += np.bincount(buckets, values * error[rows], minlength=len(weights) - 1)
            total[-1] += error.sum()
        if any_row:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()], pa.binary())], ["part", "gradient"])

    return table.mapInArrow(run, "part long, gradient binary")


def _added(rows: pa.Table) -> pa.Table:
    ordered = rows.sort_by("part")
    total = sum(np.frombuffer(g) for g in ordered.column("gradient").to_pylist())
    return pa.table({"part": ordered.column("part").slice(0, 1), "gradient": pa.array([total.tobytes()], pa.binary())})


def tree_sum(parts: DataFrame, tasks: int, fan_in: int = 32) -> np.ndarray | None:
    """The sum of the tasks' vectors: ``fan_in`` at a time meet in one task until as many are left for the driver."""
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        parts = parts.groupBy(F.pmod("part", F.lit(tasks)).alias("branch")).applyInArrow(_added, "part long, gradient binary")
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks)))
    found = sorted((r["part"], r["gradient"]) for r in parts.collect())
    return sum(np.frombuffer(g) for _, g in found) if found else None


def fit_logistic(
    df: DataFrame, text_col: str, label_col: str, dim: int = 1 << 16, steps: int = 30, rate: float = 2.0, l2: float = 1e-4, balanced: bool = True
) -> LogisticModel:
    """A model of ``label_col`` (0 or 1) from the words of ``text_col``.

    ``steps`` accelerated gradient steps over all rows (Nesterov), from zero, each with ``rate`` and an L2 penalty on all weights but the
    constant. ``balanced`` gives both labels the same total importance. Rows without a text, or with another label, teach
    nothing; repeated rows count each; a single label, or none, gives a model that says 1/2 of every text.

    Rows are never shuffled: features are written once, a step reads them and sends back one vector of ``dim`` + 1
    numbers per task, which a tree adds up. Eager.
    """
    known = df.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1))
    pairs = known.select(F.col(label_col).cast("int").alias("label"), hashed_features(F.col(text_col), dim).alias("f"))
    table = settle(pairs.select("label", "f.buckets", "f.values"), "logistic-features")
    counts = {row["label"]: row["n"] for row in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = former = np.zeros(dim + 1)
    if set(counts) == {0, 1}:
        n = sum(counts.values())
        importance = {y: 1 / (2 * c) if balanced else 1 / n for y, c in counts.items()}
        tasks = table.rdd.getNumPartitions()
        shrink = np.append(np.full(dim, l2), 0.0)
        for step in range(steps):
            ahead = weights + (step / (step + 3)) * (weights - former)
            gradient = tree_sum(_gradients(table, ahead, importance), tasks)
            weights, former = ahead - rate * (gradient + shrink * ahead), weights
    discard(table)
    return LogisticModel(weights)
