"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles. Each permutation of the shingles'
hashes gives two signature values, its minimum and its maximum, so that half
the permutations suffice for a signature of a given length; each value agrees
between two sets with the probability of their Jaccard similarity. Documents that
agree on a band of values are candidates, and candidates are confirmed on their
full sets.

Equal sets are one node from the start. The nodes of a band's bucket are compared
with the bucket's hub first, one pair per node: the hub is the node that shares most buckets with
most nodes, such as the original among edited copies. Only nodes that are still in
different components after that are compared with each other. Pairs within a
component cannot change it and are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle
from .components import connected_components
from .words import Words, chunks, mix, seeds, sequence_hashes, signed


@dataclass(frozen=True)
class NearRule:
    """What counts as near, and how candidates are found.

    ``bands`` * ``rows`` signature values come from half as many permutations.
    With 48 bands of 7 a pair of similarity 0.8 shares no band with a probability
    of 1e-5, one of similarity 0.3 shares one with a probability of 1 %. One bit of each of the first 320
    values is a sketch, in which sets of similarity s agree on a share of (1 + s) / 2 of the bits. A candidate is
    compared in full unless its sketch is more than ``deviations`` standard deviations below that of the threshold
    (3e-5 of the pairs at the threshold).
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 7
    deviations: float = 4.0

    @property
    def values(self) -> int:
        return self.bands * self.rows

    @property
    def most_differing(self) -> int:
        p, n = (1 - self.percent / 100) / 2, 64 * len(SKETCH)
        return int(n * p + self.deviations * (n * p * (1 - p)) ** 0.5)


#: The columns of the sketch, 64 bits each.
SKETCH = [f"sketch_{i}" for i in range(5)]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, text after text; where each text's begin).

    A text of fewer than ``k`` words has one shingle, all its words; one without
    words has none.
    """
    all_k = sequence_hashes(words.hash, k)
    parts, sizes = [], np.zeros(words.hi - words.lo, np.int64)
    for i, (begin, end) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if end - begin >= k:
            part = np.unique(all_k[begin : end - k + 1])
        elif end > begin:
            part = mix(sequence_hashes(words.hash[begin:end], end - begin))
        else:
            continue
        parts.append(part)
        sizes[i] = len(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(docs: DataFrame, rule: NearRule) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (the set's fingerprint), bands, and the sketch's columns."""
    multiply, add = seeds(rule.values // 2 + 1, 1000) | np.uint64(1), seeds(rule.values // 2 + 1, 5000)
    weights = seeds(rule.rows, 9000) | np.uint64(1)
    band_salt = seeds(rule.bands, 9500)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch, "text", lower=True):
                items, first = shingles(words, rule.shingle)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                at = first[:-1][full]
                set_a, set_b = np.zeros((2, len(sizes)), np.uint64)
                bands = np.zeros((len(sizes), rule.bands), np.uint64)
                sketch = np.zeros((len(sizes), len(SKETCH)), np.uint64)
                if len(full):
                    set_a[full] = np.add.reduceat(mix(items), at)
                    set_b[full] = np.add.reduceat(mix(items ^ weights[0]), at)
                    values = np.empty((rule.values, len(full)), np.uint64)
                    half = -(-rule.values // 2)
                    for p in range(half):
                        permuted = items * multiply[p]
                        permuted += add[p]
                        values[p] = np.minimum.reduceat(permuted, at)
                        if half + p < rule.values:
                            values[half + p] = np.maximum.reduceat(permuted, at)
                    values = mix(values)
                    bits = (values[: 64 * len(SKETCH)] & np.uint64(1)).astype(np.uint8).T
                    sketch[full] = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)
                    by_band = values.reshape(rule.rows, rule.bands, len(full))  # a band takes values far apart
                    bands[full] = mix((by_band * weights[:, None, None]).sum(0) + band_salt[:, None]).T
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sizes) + 1) * rule.bands, pa.int32()), pa.array(signed(bands.reshape(-1)))
                )
                ids = batch.column("doc_id").slice(words.lo, words.hi - words.lo)
                numbers = [pa.array(signed(np.ascontiguousarray(x))) for x in (set_a, set_b, *sketch.T)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *numbers, lists], ["doc_id", "n_shingles", "set_a", "set_b", *SKETCH, "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = ", ".join(f"{c} long" for c in SKETCH)
    return rows.mapInArrow(sign, f"doc_id long, n_shingles long, set_a long, set_b long, {sketch}, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the array of its distinct shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch, "text", lower=True):
                items, first = shingles(words, k)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed(items)))
                ids = batch.column("doc_id").slice(words.lo, words.hi - words.lo)
                yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "shingles"])

    return docs.mapInArrow(sets, "doc_id long, shingles array<long>")


def _side(nodes: DataFrame, x: str, *more: str) -> DataFrame:
    """The nodes as side ``a`` or ``b`` of pairs."""
    return nodes.select(*more, F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n_shingles", *SKETCH)))


def _may_be_near(rule: NearRule) -> Column:
    """Whether the sizes and sketches of sides a and b allow the threshold."""
    sizes = [F.col("n_shingles_a"), F.col("n_shingles_b")]
    return (100 * F.least(*sizes) >= rule.percent * F.greatest(*sizes)) & (_differing() <= rule.most_differing)


def _differing() -> Column:
    """On how many bits the sketches of sides a and b differ."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH])


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """The pairs that reach the threshold on their full sets."""
    rows = pairs.select("a", "b")
    for x in "ba":
        rows = rows.join(sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")), x)
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return rows.where(100 * common >= rule.percent * union).select("a", "b")


#: Nodes of a family that meet in one block, and rows that one task gets.
BLOCK, TASK_ROWS = 256, 4096


def _within_families(labels: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """Links (a, b) between different components of a family, enough to connect what is linked.

    A family is cut into blocks; a task gets pairs of blocks with the full sets, and gives back links only.
    """
    sizes = labels.groupBy("family").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = sizes.where("low < high").select("family", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = labels.join(sizes, "family").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("other", "blocks")
    rows = settle(rows, "families")
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.join(sets.withColumnRenamed("doc_id", "node"), "node")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("family", "low", "high"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(lambda table: _block_links(table, rule), "a long, b long")


def _block_links(table: pa.Table, rule: NearRule) -> pa.Table:
    """Links of some block pairs: of the pairs that sizes and sketches allow, until their ends are connected."""
    table = table.sort_by([(c, "ascending") for c in ("family", "low", "high", "node")])
    family, low, high, side, node, component, size = (table.column(c).to_numpy() for c in ("family", "low", "high", "side", "node", "component", "n_shingles"))
    sketch = np.stack([table.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64)
    column = table.column("shingles").combine_chunks()
    items, first = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(family) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0), [True]]))
    links: list[tuple[int, int]] = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        parent = {int(c): int(c) for c in component[lo:hi]}

        def root(c: int, parent=parent) -> int:
            while parent[c] != c:
                c = parent[c]
            return c

        for i in range(lo, hi):
            rest = np.arange(i + 1, hi)
            allowed = (component[rest] != component[i]) & ((low[i] == high[i]) | (side[rest] != side[i]))
            allowed &= 100 * np.minimum(size[rest], size[i]) >= rule.percent * np.maximum(size[rest], size[i])
            rest = rest[allowed]
            rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1) <= rule.most_differing]
            for j in rest.tolist():
                a, b = root(int(component[i])), root(int(component[j]))
                if a == b:
                    continue
                common = len(np.intersect1d(items[first[i] : first[i + 1]], items[first[j] : first[j + 1]], assume_unique=True))
                if 100 * common >= rule.percent * (size[i] + size[j] - common):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def near_duplicates(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach, the document itself
    included; ``kept`` marks the document that bears it. Words are split at ASCII
    white space after A-Z is lowered. A document without words links with nothing;
    rows of one doc_id are one document; a row without a doc_id has no
    component and is kept. Other columns are not read. Eager: it writes
    signatures, candidate pairs and links.
    """
    signed_docs = settle(signatures(docs, rule), "signatures")
    filled = signed_docs.where("n_shingles > 0 and doc_id is not null")
    classes = settle(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "classes")
    nodes = filled.withColumn("node", F.col("doc_id")).join(classes, ["node", "set_a", "set_b"])  # no key is shared by many

    keys = nodes.select("node", "n_shingles", *SKETCH, F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    found = settle(keys.join(shared.select("key", "n"), "key"), "buckets")
    shares = settle(found.groupBy("node").agg(F.sum("n").alias("shares")), "shares")
    ranked = found.select("key", "node").join(shares, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("shares", (-F.col("node")).alias("node"))).alias("hub"))
    members = settle(found.drop("n").join(hubs.select("key", (-F.col("hub.node")).alias("pivot")), "key"), "members")
    in_buckets = settle(members.select("node", "n_shingles", *SKETCH).distinct(), "candidates")
    near_docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    near_docs = near_docs.join(in_buckets.select(F.col("node").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    sets = settle(shingle_sets(near_docs, rule.shingle), "sets")

    pairs = _side(members.where("pivot != node"), "b", F.col("pivot").alias("a")).distinct().join(_side(in_buckets, "a"), "a")
    likely = settle(pairs.where(_may_be_near(rule)).select("a", "b", _differing().alias("differing")), "pairs")

    # Each node with the hub it is most like; then with its others, where it still matters.
    best = likely.groupBy("b").agg(F.min(F.struct("differing", "a")).alias("best")).select("best.a", "b")
    links = settle(_confirmed(best, sets, rule), "links")
    rest = _apart(likely.select("a", "b"), _two_steps(links))
    more = settle(_confirmed(rest, sets, rule), "links")
    reached = settle(connected_components(links.union(more)), "components")

    # What no hub has joined: nodes in different components that may still be near. Those of one
    # family, which sketches connect through hubs, are compared within tasks; the few others as pairs.
    families = connected_components(likely).withColumnRenamed("component", "family")
    labels = in_buckets.join(reached, "node", "left").join(families, "node", "left")
    labels = settle(labels.withColumns({x: F.coalesce(x, "node") for x in ("component", "family")}), "labels")
    labelled = members.where("node != pivot").select("key", "node").join(labels, "node")
    split = labelled.groupBy("key").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low < high")
    split = labelled.join(split.select("key"), "key", "left_semi")
    left, right = (_side(split, x, "key", F.col("family").alias(f"family_{x}")) for x in "ab")
    cross = left.join(right, "key").where(F.expr("a < b and family_a != family_b") & _may_be_near(rule)).select("a", "b").distinct()
    late = _confirmed(cross, sets, rule).union(_within_families(labels, sets, rule))
    late = settle(late, "links")
    # Rows of one doc_id with different texts are one document.
    held = filled.join(classes, ["set_a", "set_b"]).select("doc_id", "node")
    several = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    same = held.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a != b")
    # These few join components as wholes.
    ends = _labelled(late.union(same), reached).select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))
    wider = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("wider"))

    owner = classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    owner = owner.join(wider, "component", "left").select("set_a", "set_b", F.coalesce("wider", "component").alias("component"))
    owner = settle(owner, "owners")
    discard(classes, found, shares, members, in_buckets, sets, likely, links, more, late, reached, labels)
    found = signed_docs.select("doc_id", "n_shingles", "set_a", "set_b").join(owner, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept")
    )


def _two_steps(links: DataFrame) -> DataFrame:
    """Where two links lead from each node that has one as ``b``: a cheap part of its component."""
    first = links.select(F.col("b").alias("node"), F.col("a").alias("next"))
    second = first.select(F.col("node").alias("next"), F.col("next").alias("last"))
    return first.join(second, "next", "left").select("node", F.coalesce("last", "next").alias("component"))


def _labelled(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """Pairs with the components of both ends."""
    for x in "ab":
        pairs = pairs.join(reached.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}")), x, "left")
    return pairs.withColumns({f"in_{x}": F.coalesce(f"in_{x}", x) for x in "ab"})


def _apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    return _labelled(pairs, reached).where("in_a != in_b").select("a", "b")
