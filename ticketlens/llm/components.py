"""Connected components of an edge table, by large and small stars.

Each round replaces edges until every node points at the smallest node of its
component (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
A node with very many edges is no hot group: its minimum combines before the
shuffle, and the join that follows is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: join each node's neighbours to the smallest of them and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    least = side.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    least = least.withColumn("least", F.least("node", "least"))
    near = side.join(least, F.col("a") == F.col("node"))
    if large:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.where("a != b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another one.

    ``component`` is the smallest node that is reachable. Edges with a null end,
    and from a node to itself, are left out; repeated ones count once. Eager: it
    runs until a round changes nothing, and writes each round's edges.
    """
    tidy = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    now = settle(tidy.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # The sum of the edges' ends falls with every round that changes any.
        state = now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, last = state, now
        now = settle(_stars(_stars(now, large=True), large=False), "edges")
        discard(last)
