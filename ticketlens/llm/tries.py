"""The trie of conversations' beginnings, from double-array tries of prefix shards.

A node is a distinct sequence of first turns; its members are the conversations that begin with
it. Turns travel as 128-bit digests. Equal sequences are one weighted row before anything is grouped. Sequences are
dealt into shards by a prefix; a prefix that stands before too many turns is split by a longer one,
of twice the length, and so on. Each shard packs its sequences into a double array over its own dense turn ids:
the child of state s by turn t is at ``BASE[s] + t``, if ``CHECK`` there is s. Building it, a level at a
time, walks all sequences from state to state; that walk finds the nodes and their members, and sums over subtrees go back
up the levels. Nodes above a shard's prefix are shared with other shards: their partial aggregates are merged
in one group-by, and what lies below them is added along their paths.

A very long conversation is cut into segments. A segment's trie hangs on the node where the segment before
it ends, so the segments are worked on from the last to the first, and no row or task ever holds more than a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, settle

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

_SHARD = (
    "shared boolean, key binary, path array<binary>, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "words long, n_convs long, n_children long, n_leaves long, saved long, n_ends long, e1 long, e2 long"
)
_LOW = 0xFFFFFFFF


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t \\n \\v \\f \\r."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, words): each turn's place in its conversation, digest of its role and text, and words.

    By turn, null first; of equal ones by digest, so that repeated rows are turns of their own. Null role or text
    is empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").alias("_turn"), digest.alias("turn"), word_count(text).cast("int").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "turn")
    return rows.select("conv_id", F.row_number().over(order).alias("position"), "turn", "words")


def _segments(turns: DataFrame, order: list[str], length: int) -> DataFrame:
    """One row per conversation and segment of ``length`` turns: its turns, and what names the sequence up to its start, end and powers of two.

    A sequence of turns is named by the sums, modulo 2**32, of four 32-bit hashes of (place, turn): running sums, so that no conversation is
    gathered. Two sequences share the name with a probability of 2**-128.
    """
    w = Window.partitionBy("conv_id").orderBy(*order)
    rows = turns.withColumn("depth", F.row_number().over(w)).withColumns(
        {f"h{i}": F.xxhash64(F.lit(i), "depth", "turn") for i in (1, 2)}
    )
    halves = {f"{n}{i}": F.col(f"h{i}").bitwiseAND(_LOW) if n == "a" else F.shiftrightunsigned(f"h{i}", 32) for i in (1, 2) for n in "ab"}
    sums = {f"s{c}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in halves}
    rows = rows.withColumns(halves).withColumns({**sums, "ends": F.lead("depth").over(w).isNull()})

    def name(i: int, before: bool) -> Column:
        low, high = (F.col(f"s{n}{i}") - (F.col(f"{n}{i}") if before else F.lit(0)) for n in "ab")
        return low.bitwiseAND(_LOW).bitwiseOR(F.shiftleft(high, 32))

    relative = F.pmod(F.col("depth") - 1, F.lit(length)) + 1
    here = F.struct(name(1, False).alias("k1"), name(2, False).alias("k2"))
    before = F.struct(name(1, True).alias("k1"), name(2, True).alias("k2"))
    mark = F.when(relative.bitwiseAND(relative - 1) == 0, F.struct(relative.alias("depth"), here.alias("key")))
    rows = rows.select("conv_id", F.floor((F.col("depth") - 1) / length).cast("int").alias("segment"), "depth", "turn", "words", "ends", here.alias("here"), before.alias("before"), mark.alias("mark"))
    return rows.groupBy("conv_id", "segment").agg(
        F.min_by("before", "depth").alias("start"),
        F.max_by("here", "depth").alias("end"),
        F.max("ends").alias("ends"),
        F.max("depth").cast("long").alias("last"),
        F.sort_array(F.collect_list("mark")).alias("marks"),
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "turn", "words"))), lambda t: F.struct(t["turn"], t["words"])).alias("seq"),
    )


class DoubleArray:
    """A trie in two arrays. State 0 is the root; ``check`` of a free place is -1, and the last place is always free."""

    def __init__(self, room: int = 1024):
        self.base = np.zeros(room, np.int64)
        self.check = np.full(room, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no place before this one is free
        self.end = 1  # every place from this one on is free

    def _grow(self, size: int) -> None:
        if size >= len(self.check):
            more = max(size + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, symbols: np.ndarray) -> int:
        """The first place found for the least of the symbols at which all of them fall on free places."""
        ahead = symbols - symbols[0]
        self._grow(self.end + int(ahead[-1]) + 1)
        at = self.free
        for size in (16, 64, 256, 1024):
            size = max(1, min(size, 1_000_000 // len(symbols)))
            places = at + np.flatnonzero(self.check[at : at + 16 * size] < 0)[:size]
            places = places[places < self.end]
            if not len(places):
                break
            fits = (self.check[places[:, None] + ahead] < 0).all(1)
            if fits.any():
                return int(places[fits.argmax()])
            at = int(places[-1]) + 1
        return self.end

    def add(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Give each of the (state, symbol) pairs, all different and sorted, a place. States get children only once."""
        new = np.concatenate([[True], states[1:] != states[:-1]])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(states)))
        for i in np.flatnonzero(counts > 1)[np.argsort(-counts[counts > 1], kind="stable")].tolist():
            children = symbols[first[i] : first[i] + counts[i]]
            state = int(states[first[i]])
            self.base[state] = self._place(children) - children[0]
            self._take(self.base[state] + children, state)
        single = first[counts == 1]
        if len(single):
            self._grow(self.end + len(single))
            places = self.free + np.flatnonzero(self.check[self.free : self.end + len(single)] < 0)[: len(single)]
            self.base[states[single]] = places - symbols[single]
            self._take(places, states[single])
            self.free = int(places[-1]) + 1
        return self.step(states, symbols)

    def _take(self, places: np.ndarray, states) -> None:
        self.check[places] = states
        self.end = max(self.end, int(places.max()) + 1)
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of states by symbols, which must be there."""
        places = self.base[states] + symbols
        if (self.check[places] != states).any():
            raise KeyError("not in the trie")
        return places


def _shard_nodes(rows: pa.Table, offset: int) -> pa.Table:
    """The nodes of one shard's sequences, all of which begin at the depth ``offset``."""
    count = rows.num_rows
    column = {c: rows.column(c).to_numpy() for c in ("shared_to", "rep", "n", "n_ends", "e1", "e2", "b_children", "b_leaves", "b_saved", "s1", "s2", "start_conv")}
    seq = rows.column("seq").combine_chunks()
    lengths = pc.list_value_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = seq.flatten()
    digests = np.array(inner.field("turn").to_pylist(), "S16") if len(inner) else np.zeros(0, "S16")
    turns, ids = np.unique(digests, return_inverse=True)  # dense turn ids
    turn_words = np.zeros(len(turns), np.int64)
    turn_words[ids] = inner.field("words").to_numpy()
    first = np.cumsum(lengths) - lengths
    starts, start_ids = np.unique(np.stack([column["s1"], column["s2"]], 1), axis=0, return_inverse=True)
    start_ids = start_ids.reshape(-1) + len(turns)  # where a segment starts is its first symbol

    trie = DoubleArray(2 * (len(ids) + len(turns) + count) + 16)
    node_at = np.zeros(len(trie.check), np.int64)
    parents, symbols, levels = [], [], []
    n_nodes, state, node = 0, np.zeros(count, np.int64), np.full(count, -1, np.int64)
    size = len(ids) + count  # at most so many nodes
    n_convs, n_ends = np.zeros(size, np.int64), np.zeros(size, np.int64)
    below = {c: np.zeros(size, np.int64) for c in ("b_children", "b_leaves", "b_saved")}
    conv, shared = np.full(size, np.iinfo(np.int64).max), np.zeros(size, bool)
    ends = {c: np.zeros(size, np.int64) for c in ("e1", "e2")}
    for d in range(int(lengths.max(initial=0)) + 1):
        active = np.flatnonzero(lengths >= d)
        symbol = start_ids[active] if d == 0 else ids[first[active] + d - 1]
        alphabet = len(turns) + len(starts)
        pairs = np.unique(state[active] * alphabet + symbol)
        old, new = np.divmod(pairs, alphabet)
        places = trie.add(old, new)
        if len(node_at) < len(trie.check):
            node_at = np.concatenate([node_at, np.zeros(len(trie.check) - len(node_at), np.int64)])
        parents.append(node_at[old] if d else np.full(len(places), -1))
        symbols.append(new)
        levels.append(np.full(len(places), d))
        node_at[places] = n_nodes + np.arange(len(places))
        n_nodes += len(places)
        state[active] = trie.step(state[active], symbol)
        node[active] = node_at[state[active]]
        np.add.at(n_convs, node[active], column["n"][active])
        np.minimum.at(conv, node[active], column["rep"][active] if d else np.minimum(column["rep"], column["start_conv"])[active])
        shared[node[active]] |= d < column["shared_to"][active]
    np.add.at(n_ends, node, column["n_ends"])
    for c, values in below.items():
        np.add.at(values, node, column[c])
    for c, values in ends.items():
        values[node] = column[c]

    parent, symbol, level = (np.concatenate(x) for x in (parents, symbols, levels))
    words = np.where(level > 0, turn_words[np.minimum(symbol, max(len(turns) - 1, 0))] if len(turns) else 0, 0)
    children, leaves, saved = (below[c][:n_nodes] for c in ("b_children", "b_leaves", "b_saved"))
    n_convs, n_ends, conv, shared = n_convs[:n_nodes], n_ends[:n_nodes], conv[:n_nodes], shared[:n_nodes]
    for d in range(int(level.max()), -1, -1):
        own = np.flatnonzero((level == d) & ~shared)
        leaves[own] += children[own] == 0
        saved[own] += (n_convs[own] - 1) * words[own]
        for total, part in ((children, np.ones(len(own), np.int64)), (leaves, leaves[own]), (saved, saved[own])):
            np.add.at(total, parent[own], part)

    keys: list = [None] * n_nodes
    paths: list = [None] * n_nodes
    for i in np.flatnonzero(shared).tolist():
        if level[i] == 0:
            keys[i] = b"%d,%d" % tuple(starts[symbol[i] - len(turns)].tolist())
            paths[i] = [keys[i]]
        else:
            up = keys[parent[i]]
            keys[i] = hashlib.sha256(up + turns[symbol[i]].ljust(16, b"\0")).digest()[:16]
            paths[i] = [*paths[parent[i]], keys[i]]
    up = np.maximum(parent, 0)
    parent_keys = [keys[p] if l else None for p, l in zip(parent.tolist(), level.tolist(), strict=True)]
    inside = (level > 0) & ~shared & ~shared[up]
    return pa.table(
        {
            "shared": pa.array(shared),
            "key": pa.array(keys, pa.binary()),
            "path": pa.array(paths, pa.list_(pa.binary())),
            "parent_key": pa.array(parent_keys, pa.binary()),
            "conv_id": conv,
            "depth": level + offset,
            "parent_conv_id": pa.array(conv[up], mask=~inside),
            "words": words.astype(np.int64),
            "n_convs": n_convs,
            "n_children": children,
            "n_leaves": leaves,
            "saved": saved,
            "n_ends": n_ends,
            "e1": ends["e1"][:n_nodes],
            "e2": ends["e2"][:n_nodes],
        }
    )


def _nodes_from(offset: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _shard_nodes(rows, offset)


def _dealt(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """Adds shard and shared_to: the first depth of the segment that only this shard has.

    A prefix with more than ``limit`` turns behind it is not a shard; a longer one is. A sequence all of whose prefixes are such is
    a shard of its own, whose nodes are all shared.
    """
    turns = F.col("last") - base
    total = rows.agg(F.sum(turns)).first()[0] or 0
    shards = int(total // limit) + 1
    marked = rows.select("rep", turns.alias("turns"), F.posexplode("marks").alias("i", "mark"))
    sizes = marked.groupBy(F.col("mark.depth").alias("depth"), F.col("mark.key").alias("key")).agg(F.sum("turns").alias("turns"))
    large = settle(sizes.where(F.col("turns") > limit).select("depth", "key"), "large-prefixes") if shards > 1 else None
    split = F.lit(0)
    if large is not None and not large.isEmpty():
        known = marked.select("rep", F.col("mark.depth").alias("depth"), F.col("mark.key").alias("key")).join(large, ["depth", "key"])
        rows = rows.join(known.groupBy("rep").agg(F.count("*").cast("int").alias("_split")), "rep", "left")
        split = F.coalesce("_split", F.lit(0))
    mark = F.get("marks", split)
    key = F.coalesce(mark["key"], F.col("end"))
    return rows.withColumns(
        {"shared_to": F.coalesce(mark["depth"], turns + 1).cast("long"), "shard": F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")}
    )


def _merged(found: DataFrame) -> DataFrame:
    """The nodes of one segment from its shards: what is shared is summed, and parents are named."""
    part = found.where("shared").groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("path").alias("path"), F.max("words").alias("words"),
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "n_ends")],
        F.max(F.when(F.col("n_ends") > 0, F.struct("e1", "e2"))).alias("e"),
    )
    merged = settle(part, "shared-nodes")
    inner = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = merged.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    alone = nodes.select(
        F.explode("path").alias("key"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    sums = alone.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    upper = nodes.drop("n_leaves", "saved", "more").join(sums, "key")
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    fields = ["key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "n_ends", "e1", "e2"]
    upper = upper.withColumns({"parent_conv_id": F.lit(None).cast("long"), "e1": F.col("e.e1"), "e2": F.col("e.e2")}).select(fields)
    lower = found.where("not shared").select(fields)
    hanging = upper.union(lower.where("parent_key is not null")).join(names, "parent_key", "left")
    return hanging.withColumn("parent_conv_id", F.col("_parent")).select(fields).union(lower.where("parent_key is null"))


def _ends(segments: DataFrame) -> DataFrame:
    """(e1, e2, depth, ends_sha256) of the conversations with equal sequences.

    Ids are sorted in blocks of 4,096 neighbouring numbers, and the blocks' strings stream through the hash in
    order: SHA-256 of a list of any length, in bounded memory.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ended = segments.where("ends").select(F.col("end.k1").alias("e1"), F.col("end.k2").alias("e2"), F.col("last").alias("depth"), "conv_id")
    blocks = ended.groupBy("e1", "e2", "depth", F.shiftright("conv_id", 12).alias("block")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "depth", "ids")), strict=True):
                if key == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node is not None:
                        for c, v in zip(out, (*node, digest.hexdigest()), strict=True):
                            c.append(v)
                    node, digest = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["e1", "e2", "depth", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([digest.hexdigest()])], ["e1", "e2", "depth", "ends_sha256"])

    ordered = blocks.repartition("e1", "e2", "depth").sortWithinPartitions("e1", "e2", "depth", "block")
    return ordered.mapInArrow(hashed, "e1 long, e2 long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, order: list[str], members: DataFrame | None = None, shard_turns: int = 200_000, segment: int = 4096) -> DataFrame:
    """One row per node of the trie of conversations.

    ``turns`` has conv_id, turn (a digest of 16 bytes), words and the ``order`` columns, which must order a conversation's turns
    totally; ``members`` may add conv_ids that have no turn. A node is (smallest member, depth). The root
    has depth 0 and no parent; n_leaves counts the childless nodes of the subtree, itself included; saved_tokens sums (members - 1)
    times words over the subtree; ends_sha256 is the SHA-256 of the ascending, comma-joined ids of the members that have no further turn.

    No conversation: no row. Copies of a conversation, however many, are one sequence before anything is grouped; a beginning that very
    many share is split into shards of about ``shard_turns`` turns; of a very long conversation a task
    holds ``segment`` turns at most. Eager: sequences, shards' nodes and shared nodes are written.
    """
    rows = turns.select("conv_id", *order, "turn", "words")
    parts = _segments(rows, order, segment)
    if members is not None:
        origin = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
        fields = {f.name: f.dataType for f in parts.schema.fields}
        silent = members.select("conv_id").distinct().join(rows.select("conv_id").distinct(), "conv_id", "left_anti")
        values = {"segment": F.lit(0), "start": origin, "end": origin, "ends": F.lit(True), "last": F.lit(0), "marks": F.array(), "seq": F.array()}
        parts = parts.union(silent.select("conv_id", *[values[c].cast(fields[c]).alias(c) for c in parts.columns[1:]]))
    parts = settle(parts, "segments")
    same = parts.groupBy("segment", "start", "end").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.count_if("ends").alias("n_ends"),
        *[F.first(c).alias(c) for c in ("last", "marks", "seq")],
    )
    same = settle(same, "sequences")
    deepest = same.agg(F.max("segment")).first()[0]
    nodes: list[DataFrame] = []
    below = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = same.where(F.col("segment") == level)
        if below is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in ("b_children", "b_leaves", "b_saved")})
        else:
            here = here.join(below, "end", "left").fillna(0, ["b_children", "b_leaves", "b_saved"])
        above = same.where(F.col("segment") == level - 1).select(F.col("end").alias("start"), F.col("rep").alias("start_conv"))
        here = here.join(above, "start", "left") if level else here.withColumn("start_conv", F.col("rep"))
        base = level * segment
        work = _dealt(here, base, shard_turns).select(
            "shard", "shared_to", "rep", "n", "n_ends", "b_children", "b_leaves", "b_saved", "start_conv", "seq",
            *[F.col(f"{side}.k{i}").alias(f"{side[0]}{i}") for side in ("start", "end") for i in (1, 2)],
        )
        shards = work.groupBy("shard").applyInArrow(_nodes_from(base), _SHARD)
        found = settle(shards, "shard-nodes")
        merged = _merged(found)
        if level:
            top = settle(merged.where(F.col("depth") == base), "segment-tops")
            key = F.struct(*[F.split_part(F.col("key").cast("string"), F.lit(","), F.lit(i)).cast("long").alias(f"k{i}") for i in (1, 2)])
            # A top has children here, so it is no leaf, and no word of its own: the segment before has that.
            below = top.select(key.alias("end"), F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved").alias("b_saved"))
            merged = merged.where(F.col("depth") > base)
        nodes.append(merged)
    none = F.sha2(F.lit(""), 256)
    if not nodes:
        discard(parts, same)
        return turns.sparkSession.createDataFrame([], NODES)
    every = reduce(DataFrame.union, nodes)
    listed = every.where("n_ends > 0").join(_ends(parts), ["e1", "e2", "depth"])
    fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens")]
    return listed.select(*fields, "ends_sha256").union(every.where("n_ends = 0").select(*fields, none.alias("ends_sha256")))
