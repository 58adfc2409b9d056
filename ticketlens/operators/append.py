"""Ids that stay: rows that come later are numbered after the ones that have an id."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .ids import dense_ids

_WORD = 64


def _places(keys: Sequence[str], bits: int, hashes: int) -> list[Column]:
    """The bits of a key: two hashes, combined (Kirsch and Mitzenmacher, 2006)."""
    first, second = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(bits)), F.pmod(F.xxhash64(F.lit(2), *keys), F.lit(bits))
    return [F.pmod(first + F.lit(i) * second, F.lit(bits)) for i in range(hashes)]


def bloom_filter(df: DataFrame, keys: Sequence[str], rows: int, bits_a_row: int = 10, most_bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of the keys as 64-bit words, of 8 MB at most: about 1 % of other keys pass, more once ``rows`` exceed the bits.

    Bits meet in aggregated words, at most one row per word. Eager.
    """
    bits = int(np.clip(rows * bits_a_row, 1 << 10, most_bits)) // _WORD * _WORD
    at = df.select(F.explode(F.array(*_places(keys, bits, 7))).alias("at"))
    one = F.expr("shiftleft(1L, int(at % 64))")
    words = np.zeros(bits // _WORD, np.int64)
    table = at.groupBy(F.floor(F.col("at") / _WORD).cast("long").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return words


def may_hold(df: DataFrame, keys: Sequence[str], words: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose key may be in the filter; none that is in it is lost. Nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def hit(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for places in batches:
            found = np.ones(len(places[0]), bool)
            for at in places:
                at = at.to_numpy()
                found &= (shared.value[at // _WORD] >> (at % _WORD)) & 1 == 1
            yield pa.array(found)

    return df.where(F.arrow_udf(hit, "boolean")(*_places(keys, len(words) * _WORD, 7)))


def append_ids(numbered: DataFrame, rows: DataFrame, keys: Sequence[str], out: str = "ticket_id", bits_a_row: int = 10) -> DataFrame:
    """``numbered`` and those of ``rows`` whose keys it lacks, these numbered on from its greatest id in the order of the keys.

    Ids that are there never change, whatever comes. Both sides have the same columns besides ``out``. Of rows that repeat a new key one is taken, the least by all
    columns; keys with a NULL are keys like any other.

    To find what is new, the stored keys are first held against a Bloom filter of the arriving ones: only the few that may match are shuffled, not
    the stored table. Eager: the arriving rows and the new ones are written.
    """
    columns = [c for c in numbered.columns if c != out]
    values = [c for c in columns if c not in keys]
    rest = F.min(F.struct(*values)).alias("_rest") if values else F.count("*").alias("_rest")
    arriving = settle(rows.groupBy(*keys).agg(rest), "arriving")
    passed = may_hold(numbered.select(*keys), keys, bloom_filter(arriving, keys, max(arriving.count(), 1), bits_a_row))
    held = passed.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for other in same[1:]:
        condition &= other
    fresh = arriving.join(held, condition, "left_anti").select(*keys, *[F.col("_rest")[c].alias(c) for c in values])
    greatest = numbered.agg(F.max(out)).first()[0] or 0
    added = dense_ids(fresh, list(keys), "_new").withColumn(out, (F.col("_new") + F.lit(greatest)).cast("long"))
    return numbered.unionByName(added.select(*numbered.columns))
