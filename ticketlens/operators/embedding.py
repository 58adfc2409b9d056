"""Text and image vectors.

An embedder is a function from a text (or binary) Column to an
``array<double>`` Column. It works on one row at a time, so filling a table's
vectors needs neither a join nor a shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import NOT_LETTERS
from .columns import add_column_if_missing
from .models import ColumnFunction, Model, model_column


#: Bytes of text whose words a task has in hand at once, but for a longer text; and words whose bucket it keeps.
SLICE_BYTES = 4 << 20
MOST_WORDS = 500_000


def embed(
    df: DataFrame,
    content: Column,
    embedder: ColumnFunction,
    out: str = "text_embedding",
    mode: str = "all",
) -> DataFrame:
    """``df`` with the vector of ``content`` in column ``out``, added if missing.

    ``mode="all"`` computes every row anew; ``"missing"`` only rows without a
    vector, the others do not reach the model.
    """
    if mode not in ("all", "missing"):
        raise ValueError(f"mode must be 'all' or 'missing', not {mode!r}")
    if mode == "all":
        return df.withColumn(out, embedder(content))
    df = add_column_if_missing(df, out, schemas.VECTOR)
    old = F.col(out)
    return df.withColumn(out, F.coalesce(old, embedder(F.when(old.isNull(), content))))


def model_embedder(model: Model) -> ColumnFunction:
    """An embedder of an injected model: list of texts (or bytes) to list of vectors."""
    return model_column(model, schemas.VECTOR)


def hashed_words(dim: int = 64) -> ColumnFunction:
    """Counts of a text's words in ``dim`` buckets, scaled to length 1.

    Stateless, so queries and base rows share one space without fitting. A text
    without a letter has no vector. A word's bucket is the first 28 bits of its
    MD5, modulo ``dim``.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets: dict[str, int] = {}
        for batch in batches:
            yield pa.concat_arrays([_unit_rows(_bucket_counts(part, dim, buckets)) for part in text_slices(batch)])

    bucket_udf = F.arrow_udf(run, schemas.VECTOR)
    # Lower-cased by Spark, so that case folding is the same as everywhere else.
    return lambda text: bucket_udf(F.lower(text))


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of about ``SLICE_BYTES`` of text: what a task makes of its words is bounded by them, not by rows. An empty batch is one slice."""
    before = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(before[1:] != before[:-1]) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def _bucket_counts(texts: pa.Array, dim: int, buckets: dict[str, int]) -> np.ndarray:
    """Word counts per row and bucket; only words new to ``buckets`` are hashed."""
    if len(buckets) > MOST_WORDS:
        buckets.clear()
    words = pc.split_pattern_regex(texts, NOT_LETTERS)
    rows = pc.list_parent_indices(words).to_numpy()
    coded = pc.list_flatten(words).dictionary_encode()
    codes = np.empty(len(coded.dictionary), dtype=np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        bucket = buckets.get(word)
        if bucket is None:
            bucket = -1 if word == "" else int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim
            buckets[word] = bucket
        codes[i] = bucket
    places = codes[coded.indices.to_numpy()] if len(coded) else np.empty(0, dtype=np.int64)
    real = places >= 0
    counts = np.bincount(rows[real] * dim + places[real], minlength=len(texts) * dim)
    return counts.reshape(len(texts), dim)


def _unit_rows(counts: np.ndarray) -> pa.Array:
    norms = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
    empty = norms == 0
    unit = counts / np.where(empty, 1.0, norms)[:, None]
    return list_array(unit, empty)


def list_array(matrix: np.ndarray, null_rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column, rows marked in ``null_rows`` as NULL."""
    keep = ~null_rows
    offsets = np.zeros(len(matrix) + 1, dtype=np.int32)
    np.cumsum(np.where(keep, matrix.shape[1], 0), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix[keep].ravel()), mask=pa.array(null_rows))


def fit_tfidf(df: DataFrame, text_col: str, dim: int = 256) -> list[float]:
    """The weight of each bucket of ``hashed_words(dim)``: ln((texts + 1) / (texts with it + 1)).

    Texts without a letter do not count. Store the weights with the table they embed: queries must
    use the same. Eager: one row per bucket is collected.
    """
    vectors = df.select(hashed_words(dim)(F.col(text_col)).alias("v")).where("v is not null")
    places = vectors.select(F.explode(F.concat(F.array(F.lit(-1)), F.filter(F.transform("v", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()))).alias("i"))
    counts = {row[0]: row[1] for row in places.groupBy("i").count().collect()}
    texts = counts.get(-1, 0)
    return [math.log((texts + 1) / (counts.get(i, 0) + 1)) for i in range(dim)]


def embed_tfidf(df: DataFrame, text_col: str, weights: list[float], out: str = "text_embedding") -> DataFrame:
    """``df`` with word counts by bucket times ``weights``, scaled to length 1; NULL where that is nought."""
    factors = F.array(*[F.lit(w) for w in weights])
    weighted = F.zip_with(F.col("_counts"), factors, lambda x, w: x * w)
    length = F.sqrt(F.aggregate("_weighted", F.lit(0.0), lambda s, x: s + x * x))
    return (
        df.withColumn("_counts", hashed_words(len(weights))(F.col(text_col)))
        .withColumn("_weighted", weighted)
        .withColumn("_length", length)
        .withColumn(out, F.when(F.col("_length") > 0, F.transform("_weighted", lambda x: x / F.col("_length"))))
        .select(*[c for c in df.columns if c != out], out)
    )
