"""Small learned tables: lookup by hash, bounded samples, and sending them to tasks."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class HashTable:
    """Values by 64-bit key, looked up for whole arrays."""

    keys: np.ndarray  # sorted
    values: np.ndarray
    heads: np.ndarray  # where keys with the same leading bits begin
    shift: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashTable:
        order = np.argsort(keys)
        keys = keys[order]
        bits = max(8, min(22, int(len(keys)).bit_length() + 1))
        heads = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return HashTable(keys, values[order], heads.astype(np.int32), 64 - bits)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it is there) of each wanted key; the row of a missing key means nothing."""
        n = len(self.keys)
        at = self.heads[wanted >> np.uint64(self.shift)]
        if not n:
            return at, np.zeros(len(wanted), bool)
        at = np.minimum(at, n - 1)
        found = self.keys[at] == wanted
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):  # few keys share their leading bits
            at[behind] += 1
            behind = behind[at[behind] < n]
            here = self.keys[at[behind]]
            found[behind] = here == wanted[behind]
            behind = behind[here < wanted[behind]]
        return np.minimum(at, n - 1), found


class Sent:
    """A broadcast value. It travels with its classes, so executors need not have this package."""

    def __init__(self, packed):
        self.packed, self.loaded = packed, None

    def __getstate__(self):
        return {"packed": self.packed, "loaded": None}

    @property
    def value(self) -> Any:
        if self.loaded is None:
            self.loaded = cloudpickle.loads(self.packed.value)
        return self.loaded


def broadcast_value(spark: SparkSession, value: Any) -> Sent:
    """Send a value of bounded size to every executor once."""
    return Sent(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


class _ByValue:
    """Unpickles to ``value``, with its classes."""

    def __init__(self, value: Any):
        self.value = value

    def __reduce__(self):
        return cloudpickle.loads, (cloudpickle.dumps(self.value),)


def broadcast_for_workers(spark: SparkSession, value: Any) -> Broadcast:
    """Send a value of bounded size once; each Python worker keeps its own copy, with what it caches, from task to task."""
    return spark.sparkContext.broadcast(_ByValue(value))


def sampled_by_class(rows: DataFrame, column: str, per_class: int, key: str | None = None, seed: int = 7) -> tuple[DataFrame, list]:
    """About ``per_class`` rows of each class at random, and the sorted classes.

    Fewer where a class has no more. By the hash of a unique ``key`` the same rows are drawn every time; without one, rows are
    drawn one by one, so that a group of copies takes no more than its share.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}
    if not counts:
        return rows.where("false"), []
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(column) == value, min(1.0, per_class / n)).otherwise(share)
    draw = F.rand(seed) if key is None else F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share), sorted(counts)
