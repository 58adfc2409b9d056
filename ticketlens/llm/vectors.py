"""Near-duplicate vectors: binary codes of randomly rotated vectors.

After a random rotation, a unit vector's code is the signs of its components. With
the stored correction factor (the inner product of vector and code) the code gives an
unbiased estimate of the inner product with any other vector, and a bound on its
error that holds but for a stated probability (Gao and Long, "RaBitQ", 2024). A pair whose
estimate cannot reach the threshold within the bound is dropped; only the rest are
recomputed in double precision.

Which pairs are looked at: the same sign bits, of several rotations, are cut into bands. Two
vectors at the threshold agree on a bit with probability 1 - angle/pi; the length of a band grows with the
logarithm of the number of vectors, so that buckets stay small, and the number of bands follows
so that a pair shares none with a fixed small probability.

Equal vectors are one class. Buckets are worked on in blocks of bounded size; a pair that
meets in several bands counts in the first. A task gives back one row per vector, however many
links it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle
from .components import connected_components
from .words import mix, seeds, signed


@dataclass(frozen=True)
class CosineRule:
    """Link at ``threshold``; a pair is missed by the bands with probability ``miss`` at most.

    ``deviations`` is the width of the confidence bound on an estimate, in units of its standard error.
    """

    threshold: float = 0.98
    miss: float = 1e-8
    deviations: float = 6.0
    block: int = 512
    task_rows: int = 16384

    def banding(self, vectors: int) -> tuple[int, int]:
        """(bits of a band, number of bands) for so many vectors."""
        bits = min(40, max(12, math.ceil(math.log2(max(vectors, 2)))))
        agree = (1 - math.acos(self.threshold) / math.pi) ** bits
        return bits, math.ceil(math.log(self.miss) / math.log1p(-agree))


@lru_cache(maxsize=64)
def rotation(size: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([size, number]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def bands_of(units: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Per vector and band the band's sign bits as one number."""
    size = units.shape[1]
    turns = -(-bits * bands // size)
    signs = np.concatenate([units @ rotation(size, t) >= 0 for t in range(turns)], axis=1)[:, : bits * bands]
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return (signs.reshape(len(units), bands, bits) * weights).sum(2, dtype=np.uint64)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each length among the vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        vectors = flat[first[rows][:, None] + np.arange(size)]
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # squares neither overflow nor vanish
        yield rows, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _buckets(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    salt = seeds(bands, 20_000)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, ids = (batch.column(x).to_numpy() for x in ("group", "class"))
            for rows, units in _matrices(batch.column("vector")):
                own = mix(group[rows].astype(np.int64).view(np.uint64))
                buckets = mix(bands_of(units, bits, bands) + salt + own[:, None])
                columns = [signed(buckets.reshape(-1)), np.repeat(ids[rows], bands)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "class"])

    return classes.select("class", "group", "vector").mapInArrow(spread, "bucket long, class long")


@dataclass
class Codes:
    """Rotated unit vectors with their binary codes and correction factors."""

    rotated: np.ndarray
    code: np.ndarray  # +-1/sqrt(size)
    factor: np.ndarray  # inner product of code and vector

    @staticmethod
    def of(units: np.ndarray) -> Codes:
        rotated = units @ rotation(units.shape[1], 0)
        code = np.where(rotated >= 0, 1.0, -1.0) / math.sqrt(units.shape[1])
        return Codes(rotated.astype(np.float32), code.astype(np.float32), (rotated * code).sum(1))

    def estimate(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Unbiased estimates of the inner products of vectors i, by their codes, with vectors j."""
        return np.einsum("ij,ij->i", self.code[i], self.rotated[j]) / self.factor[i]

    def error(self, deviations: float) -> np.ndarray:
        """Per vector, the bound on the error of its estimates."""
        size = max(self.code.shape[1] - 1, 1)
        return deviations * np.sqrt(np.maximum(1 - self.factor**2, 0) / self.factor**2 / size) + 1e-6


def _pairs(group: np.ndarray, side: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within each block pair, some hundred thousand at a time; rows are sorted by block pair."""
    edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
    left, right, n = [], [], 0
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if low[lo] == high[lo]:
            i, j = np.triu_indices(hi - lo, 1)
        else:
            ours = side[lo:hi] == low[lo]
            a, b = np.flatnonzero(ours), np.flatnonzero(~ours)
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        left.append(i + lo)
        right.append(j + lo)
        n += len(i)
        if n >= limit:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def smallest_reachable(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per node the smallest node that links reach."""
    label = np.arange(nodes)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _linked(rows: pa.Table, rule: CosineRule, bits: int, bands: int) -> pa.Table:
    """Of the vectors of some block pairs: class, how many vectors it links with, and a class it is connected to."""
    rows = rows.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending")]).combine_chunks()
    bucket, side, low, high, ids, copies = (rows.column(x).to_numpy() for x in ("bucket", "side", "low", "high", "class", "copies"))
    out = []
    column = rows.column("vector")
    for of, units in _matrices(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column):
        codes, keys = Codes.of(units), bands_of(units, bits, bands)
        error = codes.error(rule.deviations)
        links, found_i, found_j = np.zeros(len(of), np.int64), [], []
        own = mix(keys + seeds(bands, 20_000) + mix(rows.column("group").to_numpy()[of].view(np.uint64))[:, None])
        here = (signed(own) == bucket[of][:, None]).argmax(1)  # the band this bucket belongs to
        for i, j in _pairs(bucket[of], side[of], low[of], high[of]):
            maybe = codes.estimate(i, j) + error[i] >= rule.threshold
            i, j = i[maybe], j[maybe]
            maybe = codes.estimate(j, i) + error[j] >= rule.threshold
            i, j = i[maybe], j[maybe]
            exact = np.einsum("ij,ij->i", units[i], units[j]) >= rule.threshold
            i, j = i[exact], j[exact]
            first = (keys[i] == keys[j]).argmax(1) == here[i]
            np.add.at(links, i[first], copies[of][j[first]])
            np.add.at(links, j[first], copies[of][i[first]])
            found_i.append(i)
            found_j.append(j)
        if found_i:
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            root = smallest_reachable(len(of), i, j)
            some = np.unique(np.concatenate([i, j]))
            out.append(pa.table({"class": ids[of][some], "links": links[some], "root": ids[of][root[some]]}))
    empty = pa.table({x: pa.array([], pa.int64()) for x in ("class", "links", "root")})
    return pa.concat_tables([empty, *out])


def near_vectors(vectors: DataFrame, rule: CosineRule = CosineRule()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id, embedding and label. Vectors of equal label and length link from
    the threshold on. Those without a label or id, null, empty, zero, or with a null or
    non-finite component link with nothing. ``n_links`` counts the other vectors linked
    directly, copies included; ``component_id`` is the smallest vec_id reachable by links. Rows that
    repeat a vec_id are vectors of their own. Other columns are not read. Eager: it writes the classes,
    bucket members and links.
    """
    numbers = F.col("embedding").cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(numbers, lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, F.xxhash64("label", numbers)).alias("class"), F.when(usable, F.xxhash64("label")).alias("group"), F.when(usable, numbers).alias("vector"))
    classes = rows.where("class is not null").groupBy("class", "group").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")
    )
    classes = settle(classes, "classes")
    bits, bands = rule.banding(classes.count())
    buckets = _buckets(classes, bits, bands)
    shared = buckets.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("n")).where("a < b")
    # A bucket of many members is worked on in pairs of blocks.
    members = buckets.join(shared.select("bucket", F.ceil(F.col("n") / rule.block).alias("blocks")), "bucket")
    members = members.withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = settle(
        members.select("class", "bucket", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")), "members"
    )
    tasks = max(1, -(-members.count() // rule.task_rows))
    dealt = members.join(classes.select("class", "group", "copies", "vector"), "class")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(tasks)))
    linked = dealt.groupBy("task").applyInArrow(lambda t: _linked(t, rule, bits, bands), "class long, links long, root long")
    linked = settle(linked, "linked")

    reached = connected_components(linked.select("class", "root"), "class", "root")
    owners = classes.select("class", "node", "copies").join(reached.withColumnRenamed("node", "class"), "class", "left")
    owners = owners.withColumn("component", F.coalesce("component", "class"))
    least = owners.groupBy("component").agg(F.min("node").alias("component_id"))
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    result = owners.join(least, "component").join(links, "class", "left").select(
        "class", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    result = settle(result, "owners")
    discard(classes, members, linked)
    found = rows.select("vec_id", "class").join(result, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept")
    )
