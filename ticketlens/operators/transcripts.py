"""Turn tables to transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a speaker's turn begins in a raw chat.
SPEAKERS = {"user": "Customer", "assistant": "Agent"}


def speaker(role: Column) -> Column:
    chain = None
    for value, name in SPEAKERS.items():
        chain = F.when(role == value, name) if chain is None else chain.when(role == value, name)
    return chain


def _joined(parts: Column, text: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p[text]), separator)


def assemble_transcripts(turns: DataFrame, block_turns: int = 1000, separator: str = "\n") -> DataFrame:
    """One transcript per conversation: ``Customer: …`` / ``Agent: …`` in turn order.

    (conv_id, turn) is the key of ``turns``. Turns of other roles are not spoken and are
    skipped. Blocks of ``block_turns`` turns are joined to texts first and a
    conversation's blocks after, so that a long conversation is sorted in
    several tasks; the result does not depend on it.
    """
    said = turns.where(F.col("role").isin(*SPEAKERS) & F.col("text").isNotNull()).select(
        "conv_id",
        F.floor(F.col("turn") / block_turns).alias("block"),
        "turn",
        F.concat(speaker(F.col("role")), F.lit(": "), "text").alias("line"),
    )
    blocks = said.groupBy("conv_id", "block").agg(_joined(F.struct("turn", "line"), "line", separator).alias("lines"))
    return blocks.groupBy("conv_id").agg(_joined(F.struct("block", "lines"), "lines", separator).alias("transcripts"))
