"""Packing tokenized documents into sequences of one length.

Documents are cut into pieces of at most a sequence's length. The pieces are
dealt at random into groups of a few thousand, and each group is packed by
first-fit decreasing: the longest piece first, each into the first bin with room.
A tournament tree over the bins' free lengths (each node holds the larger of its
two children) finds that bin in log(bins) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .words import texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids as the ``tokenizers`` library gives them, without added tokens.

    The same vocabulary is also there as ranks, which ``tiktoken`` encodes some
    three times as fast. Texts that hold an added token's string, or characters
    outside the first Unicode plane (where the two libraries' character classes may
    be of different Unicode versions), are left to ``tokenizers``; tests compare the rest.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer)
        self.added = [t.content.encode() for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        plain = self.fast is not None and not any(a in text for a in self.added)
        if plain and int(np.frombuffer(text, np.uint8).max()) < 0xF0:
            return self.fast.encode_to_numpy(text.decode(), disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.exact.encode(text.decode(), add_special_tokens=False).ids, "<u4")


def pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = 2048, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """One row per piece of every document: doc_id, start, length, ids_crc32, doc_tokens, and with ``keep_ids`` its ids.

    A null text is an empty one; every document ends with ``end_id``, so none is
    without a piece. Rows that repeat a doc_id are documents of their own. Other
    columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                ids = np.concatenate([encoder.ids(text or b""), end])
                for start in range(0, len(ids), length):
                    part = ids[start : start + length].tobytes()
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), len(ids), part if keep_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            columns = [pa.array(c, pa.int64()) for c in out[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(out[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece; no piece is longer than ``capacity``."""
    n = len(lengths)
    leaves = 1 << max(n - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = 1
        while node < leaves:  # the first bin with room lies left if any there has
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(cut: DataFrame, length: int = 2048, group_pieces: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces; a sequence's pieces lie gapless from offset 0.

    Pieces are written once, numbered, and dealt by a hash of their number into
    groups of about ``group_pieces``: a third of all rows may be copies of one row,
    and the groups are still even. Only the last bins of a group stay partly empty.
    Eager: it writes the pieces and counts them.
    """
    table = settle(cut, "pieces")
    groups = max(1, -(-table.count() // group_pieces))
    dealt = table.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    names = table.columns

    def fit(rows: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), length)
        group = rows.column("group").to_numpy()
        out = rows.select(names)
        return out.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return dealt.groupBy("group").applyInArrow(fit, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of pieces packed with their ids: its ids, length and document parts."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    parts = F.sort_array(F.collect_list(part))  # at most ``length`` pieces
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["start"], p["length"], p["offset"])).alias("parts"),
    )
