"""Sharding over a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) of a ring; a document belongs to the
point next to its own place, clockwise. A shard holds no more rows than its
bound: what overflows a full shard goes on clockwise to the next one with
room. Only the overflow leaves its home, the least that any even placement moves.

DataFrame operations only. Documents meet the driver as one row count per point
of the ring, a number fixed by the parameters.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

_RING_BITS = 62  # places on the ring are 0 to 2**62-1
_SLICE_BITS = 50  # a slice of the ring, for the equi-join, has 2**50 places


@dataclass(frozen=True)
class Ring:
    """The points of all shards in clockwise order, and the shard of each."""

    places: tuple[int, ...]
    owners: tuple[int, ...]

    @staticmethod
    def of(shards: int, virtual_nodes: int) -> Ring:
        points = sorted(
            (int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:8], "big") >> (64 - _RING_BITS), shard)
            for shard in range(shards)
            for node in range(virtual_nodes)
        )
        return Ring(tuple(p for p, _ in points), tuple(s for _, s in points))

    def intervals(self) -> list[tuple[int, int, int, int]]:
        """(slice, first place, last place, point), cut at the slices' edges."""
        cut, out, begin = 1 << _SLICE_BITS, [], 0
        for point, last in [*enumerate(self.places), (0, (1 << _RING_BITS) - 1)]:
            while begin <= last:
                end = min(last, begin // cut * cut + cut - 1)
                out.append((begin // cut, begin, end, point))
                begin = end + 1
        return out


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """How many rows each shard may hold: with no slack they are equal, or one apart."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def place(ring: Ring, loads: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Which rows of each point go where: (point, first row, end, shard, slot of the first row).

    Shards first take what is their own, in ring order, up to their bounds; then
    the overflow of each point goes on clockwise.
    """
    room, filled = list(room), [0] * len(room)
    parts, over = [], []

    def take(point: int, begin: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            parts.append((point, begin, begin + n, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return n

    for point, owner in enumerate(ring.owners):
        rows = loads.get(point, 0)
        taken = take(point, 0, rows, owner)
        if taken < rows:
            over.append((point, taken, rows))
    for point, begin, rows in over:
        at = point
        while begin < rows:
            at = (at + 1) % len(ring.owners)
            begin += take(point, begin, rows - begin, ring.owners[at])
    return parts


def _cumulative(amount: Column, window) -> Column:
    return F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shard(docs: DataFrame, shards: int = 16, virtual_nodes: int = 256, slack: float = 0.0, cell_rows: int = 8192) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, home_shard.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has none and is as
    an empty one. ``slot`` numbers a shard's rows from 0 without gaps. No shard has more than
    (1 + slack) times the mean; without slack, row counts differ by one at most.
    A document's place on the ring is the hash of its doc_id; without one, of its text's checksum.

    Equal rows (doc_id, size and checksum) are counted first and dealt out as a
    range of ranks, so a third of all rows may be one document's copies. Within a
    point, rows are ordered in cells of a hash of the whole row, so no
    group that is sorted exceeds about ``cell_rows``. Other columns are not read. Eager:
    it writes the counted rows and reads one count per point.
    """
    spark = docs.sparkSession
    ring = Ring.of(shards, virtual_nodes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    # A row of very many copies is several entries, each of a bounded number of them.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(cell_rows).cast("long")))
    entries = counted.withColumn("first", first).withColumn("n", F.least(F.col("copies") - F.col("first"), F.lit(cell_rows)))
    home = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    entries = entries.withColumn("place", F.shiftrightunsigned(home, 64 - _RING_BITS))
    entries = entries.withColumn("slice", F.shiftrightunsigned("place", _SLICE_BITS))
    intervals = spark.createDataFrame(ring.intervals(), "slice long, low long, high long, point int")
    entries = entries.join(F.broadcast(intervals), "slice").where("place between low and high")
    entries = settle(entries.select("doc_id", "size", "text_crc32", "first", "n", "point"), "ring")

    loads = {r["point"]: (r["rows"], r["entries"]) for r in entries.groupBy("point").agg(F.sum("n").alias("rows"), F.count("*").alias("entries")).collect()}
    total = sum(n for n, _ in loads.values())
    parts = place(ring, {p: n for p, (n, _) in loads.items()}, bounds(total, shards, slack))
    cells = max([1, *(-(-e // cell_rows) for _, e in loads.values())])

    order = F.xxhash64("doc_id", "size", "text_crc32", "first")
    ordered = entries.withColumn("order", order).withColumn("cell", F.pmod("order", F.lit(cells)))
    before = ordered.groupBy("point", "cell").agg(F.sum("n").alias("in_cell"))
    before = before.select("point", "cell", _cumulative(F.col("in_cell"), Window.partitionBy("point").orderBy("cell")).alias("before"))
    within = Window.partitionBy("point", "cell").orderBy("order", "doc_id", "size", "text_crc32", "first")
    ranked = ordered.join(before, ["point", "cell"]).withColumn("rank", F.col("before") + _cumulative(F.col("n"), within))
    each = F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("n") - 1))
    each = ranked.select("doc_id", "size", "text_crc32", "point", each.alias("rank"))

    plan = spark.createDataFrame(
        [(point, begin, end, to, slot, ring.owners[point]) for point, begin, end, to, slot in parts],
        "point int, begin long, end long, shard int, slot long, home_shard int",
    )
    placed = each.join(F.broadcast(plan), "point").where("rank >= begin and rank < end")
    slot = F.col("slot") + F.col("rank") - F.col("begin")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "home_shard")
