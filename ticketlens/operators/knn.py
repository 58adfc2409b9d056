"""Exact nearest neighbours.

Three ways to the same answer, by the size of the query side:

* one query vector: a distance expression and a top-k (:func:`nearest_to_vector`);
* a query set of checked size: sent to every task, the base is read once and
  never shuffled;
* any larger query set: both sides are cut into cells around pivots, cells that follow each other are
  bundled up to a bounded size, and a query meets only the cells that can hold a
  neighbour of it. It is sent once to a bundle, however many of its cells it meets.
  Of more bundles than a handful nothing is sent: both sides are stored in blocks, and
  each task reads the blocks it compares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

METRICS = ("euclidean", "cosine", "dot")

# Distances are rounded to this many decimals before ranking, so that rows at
# the same distance rank by id and not by the rounding noise of a sum.
DECIMALS = 12

# Vectors of one block, of base rows or of queries, at most.
_BLOCK_BYTES = 32 << 20
# Most pairs whose exact distance is computed at once inside a task.
_PAIRS = 100_000
# Base rows whose distances bound those of a broadcast query set.
_BOUND_ROWS = 2048
# Most query-base pairs of one approximate distance block.
_BLOCK = 2_000_000
# Queries and base rows that meet at once: their products stay in a core's cache.
_TILE = (1024, 512)
# Vectors whose lengths add up to more are not looked at in single precision.
_LONG = 1e15
# Base blocks to which rows are sent, at most; more are read where they are compared.
_SENT = 4
# Queries of one stored block.
_ASKED = 10_000


def distance_to(vector: Column, target: Sequence[float], metric: str = "euclidean") -> Column:
    """Distance of an ``array<double>`` column to one fixed vector; NULL for a
    vector that is missing, of another length, not finite, or 0 under cosine."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    _, point = _prepared(np.zeros(1), np.array([target], dtype=np.float64), metric)
    dim = len(target)

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch), dim), False)
            rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False)) if len(point) else np.empty(0, dtype=np.int64)
            usable, vectors = _prepared(rows, _vectors(batch.take(pa.array(rows)), dim), metric)
            distances = np.full(len(batch), np.nan)
            if len(usable):
                distances[usable] = _exact(vectors, np.broadcast_to(point, vectors.shape), metric)
            yield pa.array(distances, from_pandas=True)

    # Non-deterministic only in name: a filter on the distance then does not compute it again.
    return F.arrow_udf(measure, T.DoubleType()).asNondeterministic()(vector)


def nearest_to_vector(
    base: DataFrame,
    target: Sequence[float],
    k: int,
    id_col: str,
    vector_col: str,
    metric: str = "euclidean",
) -> DataFrame:
    """The ``k`` base rows nearest to ``target``, all their columns plus ``distance``.

    Each task keeps its own best ``k`` rows; only those meet.
    """
    distance = distance_to(F.col(vector_col).cast("array<double>"), target, metric)
    return base.withColumn("distance", distance).where(F.col("distance").isNotNull()).orderBy("distance", id_col).limit(k)


# --- inside a task -----------------------------------------------------------


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _prepared(ids: np.ndarray, vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector; under cosine scaled to length 1."""
    usable = np.isfinite(vectors).all(axis=1)
    if metric == "cosine":
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        usable &= lengths > 0
        vectors = vectors / np.where(usable, lengths, 1.0)[:, None]
    return ids[usable], vectors[usable]


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        diff = a - b
        distance = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    else:
        dot = np.einsum("ij,ij->i", a, b)
        distance = -dot if metric == "dot" else 1.0 - dot
    return np.round(distance, DECIMALS) + 0.0  # no negative zero


def _rough(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances by matrix product, squared if euclidean, and a bound on their error."""
    dots = a @ b.T
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 1e-11 * (1.0 + a2.max(initial=0.0) + b2.max(initial=0.0))
    if metric == "euclidean":
        return a2[:, None] + b2[None, :] - 2.0 * dots, error
    return (-dots if metric == "dot" else 1.0 - dots), error


def _single(vectors: np.ndarray, metric: str, base: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in single precision, whose products of queries and base rows fall as the distance grows, and their lengths."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    if metric == "euclidean":
        vectors = np.column_stack([vectors, -0.5 * squares if base else np.ones(len(vectors))])
    with np.errstate(over="ignore"):
        return vectors.astype(np.float32), np.sqrt(squares)


class _Best:
    """The best ``k`` base rows so far of each query in a task.

    Most pairs are ruled out in single precision, by more than it is off by. Where that leaves many, such as before a query
    has a bound, the block is looked at in double precision. What is left is measured exactly.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, limit: np.ndarray | None = None):
        """``limit``: for each query a distance that its k-th neighbour does not exceed."""
        self.queries, self.k, self.metric = queries, k, metric
        self.limit = np.full(len(queries), np.inf) if limit is None else limit.copy()
        self.single, self.lengths = _single(queries, metric, base=False)
        self.kept = pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="object"), "d": pd.Series(dtype="float64")})
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_new = 0

    @property
    def rows(self) -> pd.DataFrame:
        self._settle()
        return self.kept

    def add(self, ids: np.ndarray, vectors: np.ndarray, some: np.ndarray | None = None) -> None:
        """Base rows that are looked at for all queries, or for ``some`` of them by their places."""
        asked = np.full(len(self.queries), some is None)
        if some is not None:
            asked[some] = True
        if not len(ids) or not asked.any():
            return
        single, lengths = _single(vectors, self.metric, base=True)
        longest = lengths.max()
        for a in range(0, len(asked), _TILE[0]):
            mine = asked[a : a + _TILE[0]]
            n = np.count_nonzero(mine)
            if not n:
                continue
            # Cheaper for all queries than for a copy of most.
            at = slice(a, a + len(mine)) if 2 * n > len(mine) else a + np.flatnonzero(mine)
            for b in range(0, len(ids), _TILE[1]):
                base = slice(b, b + _TILE[1])
                q, found = self._likely(at, asked[at], single[base], longest)
                if q is None:
                    q, found = self._near(a + np.flatnonzero(mine), vectors[base])
                self._keep(q, ids[base][found], vectors[base][found])

    def _likely(self, at: slice | np.ndarray, asked: np.ndarray, single: np.ndarray, longest: float) -> tuple[np.ndarray | None, np.ndarray]:
        """Pairs (query, base row) that may be within the queries' limits, in single precision; None if these are many."""
        lengths, limit = self.lengths[at], self.limit[at] + 10.0**-DECIMALS
        if not lengths.max() + longest < _LONG:
            return None, np.empty(0, np.int64)
        if self.metric == "euclidean":
            least = (np.square(lengths) - np.square(limit)) / 2
        else:
            least = -limit if self.metric == "dot" else 1.0 - limit
        # The terms of a product add up to no more than this, and each is off by a few units in the last place.
        least -= (self.queries.shape[1] + 8) * 2.0**-23 * np.square(lengths + longest) + 1e-36
        with np.errstate(over="ignore"):
            least = np.nextafter(np.where(asked, least, np.inf).astype(np.float32), np.float32(-np.inf), where=asked, out=np.full(len(asked), np.inf, np.float32))
        found = np.flatnonzero(self.single[at] @ single.T >= least[:, None])
        if len(found) > 2 * self.k * np.count_nonzero(asked):
            return None, found
        q, b = np.divmod(found, len(single))
        return (at.start + q if isinstance(at, slice) else at[q]), b

    def _near(self, at: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in double precision; the k-th best of many bounds what is looked for from here on."""
        rough, error = _rough(self.queries[at], vectors, self.metric)
        euclidean = self.metric == "euclidean"
        limit = self.limit[at] + 10.0**-DECIMALS
        limit = np.square(limit) if euclidean else limit
        near = rough <= limit[:, None] + 2 * error
        if len(vectors) > self.k and np.count_nonzero(near) > 2 * self.k * len(at):
            limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
            near = rough <= limit[:, None] + 2 * error
            bound = limit + 2 * error
            self.limit[at] = np.minimum(self.limit[at], np.sqrt(np.maximum(bound, 0.0)) if euclidean else bound)
        q, b = np.nonzero(near)
        return at[q], b

    def _keep(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for i in range(0, len(q), _PAIRS):
            s = slice(i, i + _PAIRS)
            self.new.append((q[s], ids[s], _exact(self.queries[q[s]], vectors[s], self.metric)))
        self.n_new += len(q)
        if self.n_new > max(_PAIRS, 2 * self.k * len(self.queries)):
            self._settle()

    def _settle(self) -> None:
        """Only the best stay of what was found since, and bound what is looked for from here on."""
        if not self.new:
            return
        new = pd.DataFrame(dict(zip(("q", "id", "d"), map(np.concatenate, zip(*self.new, strict=True)), strict=True)))
        self.new, self.n_new = [], 0
        found = pd.concat([self.kept, new]) if len(self.kept) else new
        self.kept = found.sort_values(["q", "d", "id"]).groupby("q", sort=False).head(self.k)
        full = self.kept.groupby("q")["d"].agg(["size", "max"])
        full = full[full["size"] == self.k]
        at = full.index.to_numpy()
        self.limit[at] = np.minimum(self.limit[at], full["max"].to_numpy())


def _result_batch(names: Sequence[str], schema: pa.Schema, query_ids: np.ndarray, rows: pd.DataFrame) -> pa.RecordBatch:
    columns = (query_ids[rows["q"].to_numpy(dtype=np.int64)], rows["id"].to_numpy(), rows["d"].to_numpy(dtype=np.float64))
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=schema.field(name).type, from_pandas=True) for column, name in zip(columns, names)],
        schema=schema,
    )


# --- plans -------------------------------------------------------------------


@dataclass(frozen=True)
class Side:
    """One side of a search: a table, its unique key and its vector column."""

    df: DataFrame
    id_col: str
    vector_col: str

    def rows(self, dim: int) -> DataFrame:
        """Ids and vectors; the job fails on a vector of another length."""
        vector = F.col(self.vector_col)
        wrong = F.concat(F.lit(f"{self.vector_col}: a vector of length "), F.size(vector), F.lit(f", not {dim}"))
        checked = F.when(F.size(vector) == dim, vector.cast("array<double>")).otherwise(F.raise_error(wrong))
        return self.df.where(F.col(self.id_col).isNotNull() & vector.isNotNull()).select(F.col(self.id_col).alias("id"), checked.alias("vector"))


@dataclass(frozen=True)
class Index:
    """A base table cut into cells around pivots, written once for many searches."""

    rows: DataFrame
    id_type: T.DataType
    dim: int
    metric: str
    pivots: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray  # base rows of each cell
    longest: float  # squared length of the longest vector, for dot products


def build_index(base: Side, metric: str = "euclidean", cells: int | None = None, centroids: np.ndarray | None = None) -> Index:
    """Assign every base row to the cell of its nearest pivot.

    ``cells`` pivots, by default the root of the base's rows (16 to 16384), chosen by hash of the id,
    or given as ``centroids``. Searches with an index assign only their queries. Vectors of different
    lengths are an error. Eager: the assigned rows are written, one number per cell is collected.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    length = F.size(base.vector_col)
    size = base.df.where(F.col(base.vector_col).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("dim")).head()
    dim = size["dim"] or 0
    rows, longest = base.rows(dim), 0.0
    if metric == "dot" and centroids is None:
        longest = _longest(rows)
        rows = _lifted(rows, longest)
        dim += 1
    pivots = centroids if centroids is not None else _pivots(rows, cells or int(np.clip(np.sqrt(size["n"]), 16, 16384)), metric)
    if metric == "cosine" and len(pivots):
        lengths = np.linalg.norm(pivots, axis=1)
        pivots = pivots[lengths > 0] / lengths[lengths > 0][:, None]
    kind = base.df.schema[base.id_col].dataType
    if not len(pivots):
        return Index(rows, kind, dim, metric, np.empty((0, dim)), np.empty(0), np.empty(0, np.int64), longest)
    assigned = settle(_assigned(rows, pivots, metric, dim), "knn-base")
    radii, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for row in assigned.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():  # one row per pivot
        radii[row["cell"]], sizes[row["cell"]] = row["radius"], row["n"]
    return Index(assigned, kind, dim, metric, pivots, radii, sizes, longest)


def knn(
    base: Side | Index,
    queries: Side,
    k: int,
    metric: str = "euclidean",
    broadcast_queries: int = 4096,
    broadcast_bytes: int = 64 << 20,
    chunk_rows: int | None = None,
    cells: int | None = None,
    centroids: np.ndarray | None = None,
    nprobe: int | None = None,
) -> DataFrame:
    """The ``k`` nearest base rows of every query: (query_id, base_id, distance, rank).

    Ranked by distance, then base id. Rows whose vector is NULL take no part;
    queries or base rows of different lengths are an error. Exact, unless ``nprobe`` says to look
    only in that many cells nearest to a query. The query set is broadcast when
    it has at most ``broadcast_queries`` rows and ``broadcast_bytes`` of
    vectors; the cell plan takes any size, in blocks of ``chunk_rows`` (by
    default an eighth of all, or 32 MB) over ``cells`` cells (see :func:`build_index`). An :class:`Index` as
    base is searched by its cells and metric, whatever the number of queries.
    Eager: it counts the queries, and the cell plan writes both sides.
    """
    if isinstance(base, Index):
        metric = base.metric
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    vector = F.col(queries.vector_col)
    length = F.size(vector)
    size = queries.df.where(vector.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("least"), F.max(length).alias("dim")).head()
    dim = size["dim"] or 0
    if dim != (size["least"] or 0):
        raise ValueError(f"{queries.vector_col}: queries of lengths from {size['least']} to {dim}")
    if not size["n"]:
        return _no_neighbours(base, queries)
    names = ("query_id", "base_id", "distance")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.df.schema[queries.id_col].dataType),
            T.StructField("base_id", base.id_type if isinstance(base, Index) else base.df.schema[base.id_col].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    small = size["n"] <= broadcast_queries and size["n"] * dim * 8 <= broadcast_bytes
    if small and nprobe is None and isinstance(base, Side):
        found = _by_broadcast(base.rows(dim), queries.rows(dim), k, metric, dim, names, schema)
    else:
        index = base if isinstance(base, Index) else build_index(base, metric, cells, centroids)
        asked = queries.rows(dim)
        if index.dim == dim + 1 and metric == "dot":
            asked = asked.withColumn("vector", F.concat("vector", F.array(F.lit(0.0))))
        elif len(index.pivots) and index.dim != dim:
            raise ValueError(f"{queries.vector_col}: queries of length {dim}, a base of length {index.dim}")
        chunk_rows = chunk_rows or block_rows(max(int(index.sizes.sum()), size["n"]), dim)
        found = _by_cells(index, asked, k, names, schema, chunk_rows, nprobe)
    return _ranked(found, k)


def block_rows(n: int, dim: int) -> int:
    """Rows of a block: an eighth of all, so that what is sent grows with them, while that is at most 32 MB of vectors."""
    return int(np.clip(n // 8, 1000, max(1000, _BLOCK_BYTES // (8 * max(dim, 1)))))


def _no_neighbours(base: Side | Index, queries: Side) -> DataFrame:
    kinds = queries.df.schema[queries.id_col].dataType, base.id_type if isinstance(base, Index) else base.df.schema[base.id_col].dataType
    return queries.df.sparkSession.createDataFrame(
        [], f"query_id {kinds[0].simpleString()}, base_id {kinds[1].simpleString()}, distance double, rank bigint"
    )


def _square() -> Column:
    return F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)


def _longest(rows: DataFrame) -> float:
    return rows.select(_square().alias("s")).where("s < double('infinity')").agg(F.max("s")).head()[0] or 0.0


def _lifted(rows: DataFrame, longest: float) -> DataFrame:
    """Base vectors with one more component, which brings all to the squared length ``longest``.

    Queries get 0 there, so dot products stay as they are, and their order is that of the
    Euclidean distances: cells can be ruled out by the triangle inequality.
    """
    rest = F.sqrt(F.greatest(F.lit(longest) - _square(), F.lit(0.0)))
    return rows.withColumn("vector", F.concat("vector", F.array(rest)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "base_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    simple = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64()}
    return pa.schema([(f.name, simple[type(f.dataType)]) for f in schema.fields])


def _by_broadcast(base, queries, k, metric, dim, names, schema) -> DataFrame:
    # Checked by the caller: at most broadcast_queries rows.
    table = queries.toArrow()
    ids, vectors = _prepared(
        table.column("id").to_numpy(),
        _vectors(table.column("vector").combine_chunks(), dim) if len(table) else np.empty((0, dim)),
        metric,
    )
    # The k-th best among any base rows bounds the k-th distance: tasks give back only what is below.
    some = base.limit(_BOUND_ROWS).toArrow()
    _, near = _prepared(np.arange(len(some)), _vectors(some.column("vector").combine_chunks(), dim) if len(some) else np.empty((0, dim)), metric)
    limit = np.full(len(ids), np.inf)
    if len(near) >= k:
        for part in _slices(len(ids), len(near)):
            rough, error = _rough(vectors[part], near, metric)
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error
            limit[part] = np.sqrt(np.maximum(bound, 0.0)) if metric == "euclidean" else bound
    shared = base.sparkSession.sparkContext.broadcast((ids, vectors, limit))
    arrow_schema = _arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors, limit = shared.value
        best = _Best(query_vectors, k, metric, limit)
        for batch in batches:
            if batch.num_rows:
                base_ids = batch.column(0).to_numpy(zero_copy_only=False)
                best.add(*_prepared(base_ids, _vectors(batch.column(1), dim), metric))
        yield _result_batch(names, arrow_schema, query_ids, best.rows)

    return base.mapInArrow(search, schema)


def fit_centroids(side: Side, cells: int, iterations: int = 10, seed: int = 7) -> np.ndarray:
    """K-means centres of the vectors, for searching with ``nprobe``."""
    dim = side.df.where(F.col(side.vector_col).isNotNull()).agg(F.mode(F.size(side.vector_col))).head()[0]
    points = side.rows(dim).select(array_to_vector("vector").alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=iterations).fit(points).clusterCenters())


def _pivots(base: DataFrame, cells: int, metric: str) -> np.ndarray:
    """Usable base vectors to build ``cells`` cells around, chosen by hash of their id."""
    usable = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    if metric == "cosine":
        usable &= F.exists("vector", lambda x: x != 0.0)
    chosen = base.where(usable).orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").collect()
    return np.unique(np.array([row[0] for row in chosen], dtype=np.float64), axis=0)


def _gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    rough, _ = _rough(vectors, pivots, "euclidean")
    return np.sqrt(np.maximum(rough, 0.0))


def _slices(rows: int, cells: int) -> Iterator[slice]:
    """Row ranges whose distances to all cells fill a bounded block."""
    step = max(1, _BLOCK // max(cells, 1))
    return (slice(i, i + step) for i in range(0, rows, step))


def _assigned(rows: DataFrame, pivots: np.ndarray, metric: str, dim: int) -> DataFrame:
    """Rows with the cell of their nearest pivot, the distance to it, and a number of their own."""
    schema = T.StructType(
        [rows.schema["id"], rows.schema["vector"], T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())]
    )
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = _prepared(np.arange(batch.num_rows), _vectors(batch.column(1), dim), metric)
            cell, gap = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for part in _slices(len(ids), len(shared.value)):
                gaps = _gaps(vectors[part], shared.value)
                cell[part], gap[part] = gaps.argmin(axis=1), gaps.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids)),
                    batch.column(1).take(pa.array(ids)),
                    pa.array(cell, type=pa.int64()),
                    pa.array(gap),
                ],
                names=["id", "vector", "cell", "gap"],
            )

    return rows.mapInArrow(assign, schema).withColumn("seq", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Bundles:
    """Cells that follow each other, of so many base rows together as a task holds. A larger cell is a bundle of its own, in chunks."""

    first: np.ndarray  # where a bundle's cells begin, and the end
    chunks: np.ndarray  # blocks that a bundle's base rows are dealt to

    @staticmethod
    def of(sizes: np.ndarray, chunk_rows: int) -> Bundles:
        first, rows = [], 0
        for cell, n in enumerate(sizes.tolist()):
            if not first or rows + n > chunk_rows:
                first.append(cell)
                rows = 0
            rows += n
        totals = np.add.reduceat(sizes, first)
        return Bundles(np.array([*first, len(sizes)]), np.maximum(1, -(-totals // chunk_rows)))

    def with_bundle(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bundle of their ``cell``: one row per cell goes to every task."""
        each = np.repeat(np.arange(len(self.chunks)), np.diff(self.first))
        of = rows.sparkSession.createDataFrame(list(enumerate(each.tolist())), "cell long, bundle long")
        return rows.join(F.broadcast(of), "cell")


def _met(base: DataFrame, asked: DataFrame, bundles: Bundles, chunk_rows: int, begin: Callable, schema: T.StructType) -> DataFrame:
    """What ``begin(query rows)`` finds in the base rows of every (query chunk, base chunk) pair of a bundle.

    ``base`` has a ``cell``, ``asked`` one row per query and bundle to look in, whose ``marks`` name the bundle's cells that count, all
    if NULL. So a vector is sent once for all the cells of a bundle, and a base row once for ``chunk_rows`` queries; either side of
    a group has about ``chunk_rows`` rows. What ``begin`` returns ``look``s at base rows and then has ``found`` a table.
    """
    arrow_schema, first = _arrow_schema(schema), bundles.first
    split = base.sparkSession.createDataFrame(list(enumerate(bundles.chunks.tolist())), "bundle long, base_chunks long")
    counts = asked.groupBy("bundle").agg(F.ceil(F.count("*") / chunk_rows).cast("long").alias("query_chunks"))
    counts = F.broadcast(F.broadcast(split).join(counts, "bundle"))

    def chunk(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return rows.join(counts, "bundle").select(
            *[c for c in rows.columns if c != key or c == "id"],
            F.pmod(F.xxhash64(key), f"{own}_chunks").alias(f"{own}_chunk"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_chunks") - 1)).alias(f"{other}_chunk"),
        )

    def block(key, query_rows: pa.Table, base_rows: pa.Table) -> pa.Table:
        if not len(query_rows) or not len(base_rows):
            return arrow_schema.empty_table()
        meeting, bundle = begin(query_rows), key[0].as_py()
        meeting.look(base_rows, first[bundle], _marked(query_rows.column("marks"), first[bundle + 1] - first[bundle]))
        return meeting.found()

    group = ("bundle", "base_chunk", "query_chunk")
    left = chunk(asked, "seq", "query", "base").groupBy(*group)
    right = chunk(bundles.with_bundle(base), "seq" if "seq" in base.columns else "id", "base", "query").groupBy(*group)
    return left.cogroup(right).applyInArrow(block, schema)


def _met_in_place(base: DataFrame, rows: DataFrame, cells_of, bundles: Bundles, dim: int, metric: str, begin: Callable, schema: T.StructType) -> DataFrame:
    """The same for the cells that ``cells_of(vectors, batch)`` marks for ``rows``, without sending rows to each other.

    Both sides are stored once, in blocks of one row each: ``_ASKED`` queries with the marks of all cells, and a chunk of a bundle. Each task
    reads some blocks of either side, and compares those of which a query marks a cell. So what is written grows
    with the rows, and what is read and compared with their pairs. Eager: both sides are written.
    """
    first, arrow_schema = bundles.first, _arrow_schema(schema)
    # As large on disk as in memory, so that what a task reads is bounded; and few blocks a file, as a file's are read at once.
    plain = {"compression": "none", "maxRecordsPerFile": "4"}
    asked = settle(_query_blocks(rows, cells_of, int(first[-1]), dim, metric, bundles), "knn-query-blocks", **plain)
    stored = settle(_base_blocks(base, bundles, dim), "knn-base-blocks", **plain)
    asked = asked.withColumn("block", F.monotonically_increasing_id())
    pairs = asked.hint("shuffle_replicate_nl").join(stored, F.array_contains("bundles", F.col("bundle"))).drop("bundles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                pair = {name: batch.column(name)[i] for name in batch.schema.names}
                if block != pair["block"].as_py():
                    if meeting is not None:
                        yield from meeting.found().to_batches()
                    block, ids = pair["block"].as_py(), pair["ids"].values
                    queries = {"id": ids, "vector": _unpacked(pair["vectors"], dim)}
                    if "bounds" in pair:
                        queries["bound"] = _numbers(pair["bounds"], pa.float64())
                    meeting = begin(pa.table(queries))
                    marks = np.unpackbits(np.frombuffer(pair["marks"].as_buffer(), np.uint8).reshape(len(ids), -1), axis=1)
                rows = {"id": pair["base_ids"].values, "vector": _unpacked(pair["base_vectors"], dim), "cell": _numbers(pair["base_cells"], pa.int64())}
                if "base_codes" in pair:
                    rows["code"] = pair["base_codes"].values
                begin_cell, end_cell = first[pair["bundle"].as_py()], first[pair["bundle"].as_py() + 1]
                meeting.look(pa.table(rows), begin_cell, marks[:, begin_cell:end_cell].astype(bool))
        if meeting is not None:
            yield from meeting.found().to_batches()

    return pairs.mapInArrow(compare, schema)


def _numbers(scalar: pa.Scalar, kind: pa.DataType) -> pa.Array:
    buffer = scalar.as_buffer()
    return pa.Array.from_buffers(kind, buffer.size // 8, [None, buffer])


def _unpacked(scalar: pa.Scalar, dim: int) -> pa.Array:
    """Vectors that were stored as the bytes of a matrix, as a list column again."""
    values = _numbers(scalar, pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim, dtype=np.int32)), values)


def _base_blocks(base: DataFrame, bundles: Bundles, dim: int) -> DataFrame:
    """Base rows as one row for each chunk of a bundle, by cell within. They are shuffled once."""
    begin = np.cumsum(bundles.chunks) - bundles.chunks
    of = base.sparkSession.createDataFrame(list(enumerate(zip(begin.tolist(), bundles.chunks.tolist(), strict=True))), "bundle long, at struct<begin: long, chunks: long>")
    own = F.pmod(F.xxhash64("seq" if "seq" in base.columns else "id"), F.col("at.chunks"))
    kept = ["id", "vector", "cell", *(c for c in base.columns if c == "code")]
    placed = bundles.with_bundle(base).join(F.broadcast(of), "bundle").select(*kept, "bundle", (F.col("at.begin") + own).cast("int").alias("chunk"))
    fields = [T.StructField("bundle", T.LongType()), T.StructField("base_ids", T.ArrayType(base.schema["id"].dataType))]
    fields += [T.StructField(c, T.BinaryType()) for c in ("base_vectors", "base_cells")]
    if "code" in kept:
        fields.append(T.StructField("base_codes", T.ArrayType(T.BinaryType())))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        for _, at in _by_cell(rows.column("chunk").to_numpy()) if rows else ():
            at = at[np.argsort(rows.column("cell").to_numpy()[at], kind="stable")]
            some = {c: rows.column(c).take(pa.array(at)).combine_chunks() for c in ("bundle", *kept)}
            columns = [some["bundle"][:1], _one_list(some["id"]), _one_binary(_vectors(some["vector"], dim)), _one_binary(some["cell"].to_numpy())]
            columns += [_one_list(some["code"])] if "code" in kept else []
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return placed.repartitionById(int(bundles.chunks.sum()), "chunk").mapInArrow(pack, T.StructType(fields))


def _query_blocks(rows: DataFrame, cells_of, cells: int, dim: int, metric: str, bundles: Bundles) -> DataFrame:
    """Queries as one row for each ``_ASKED`` of a task, those of a cell together, with the marks of all cells and the bundles marked by any of them."""
    bound = "bound" in rows.columns
    fields = [T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("vectors", T.BinaryType())]
    fields += [T.StructField(c, T.BinaryType()) for c in ("marks", *(["bounds"] if bound else []))]
    fields.append(T.StructField("bundles", T.ArrayType(T.LongType())))
    first = bundles.first

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _ASKED):
                batch = whole.slice(i, _ASKED)
                _, vectors = _prepared(np.arange(batch.num_rows), _vectors(batch.column("vector"), dim), metric)
                marks, some = [], np.zeros(cells, dtype=bool)
                for part in _slices(len(vectors), cells):
                    marked = cells_of(vectors[part], batch.slice(part.start, len(vectors[part])))
                    marks.append(np.packbits(marked, axis=1))
                    some |= marked.any(axis=0)
                met = np.flatnonzero(np.logical_or.reduceat(some, first[:-1]))
                if len(met):
                    columns = [_one_list(batch.column("id")), _one_binary(_vectors(batch.column("vector"), dim)), _one_binary(np.concatenate(marks))]
                    columns += [_one_binary(batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64))] if bound else []
                    yield pa.RecordBatch.from_arrays([*columns, _one_list(pa.array(met, pa.int64()))], [f.name for f in fields])

    return rows.sortWithinPartitions("cell").mapInArrow(pack, T.StructType(fields))


def _one_list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _one_binary(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).data.cast("B")], pa.binary())


def _marked(marks: pa.ChunkedArray, width: int) -> np.ndarray | None:
    """Which of a bundle's cells each query asks for; None for all."""
    if marks.null_count:
        return None
    return np.unpackbits(np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(len(marks), -1), axis=1)[:, :width].astype(bool)


def _by_cell(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell that has rows, with their places."""
    order = np.argsort(cells, kind="stable")
    ordered = cells[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(cells) else np.empty(0, np.int64)
    for a, b in zip(edge, np.append(edge[1:], len(cells)), strict=True):
        yield int(ordered[a]), order[a:b]


class _Meeting:
    """Queries of a task, and the best ``k`` of the base rows they have looked at. They may have a ``bound`` on the k-th distance."""

    def __init__(self, query_rows: pa.Table, k: int, metric: str, dim: int, names: Sequence[str], schema: pa.Schema):
        self.metric, self.dim, self.names, self.schema = metric, dim, names, schema
        self.at, vectors = _prepared(np.arange(len(query_rows)), _vectors(query_rows.column("vector").combine_chunks(), dim), metric)
        self.ids = query_rows.column("id").to_numpy()[self.at]
        bound = query_rows.column("bound").to_numpy().astype(np.float64)[self.at] if "bound" in query_rows.schema.names else np.full(len(self.at), np.nan)
        self.best = _Best(vectors, k, metric, np.where(np.isnan(bound), np.inf, bound))

    def look(self, base_rows: pa.Table, begin: int, marks: np.ndarray | None) -> None:
        """``marks``: which cells from ``begin`` on count for each query; None for all."""
        here, vectors = _prepared(np.arange(len(base_rows)), _vectors(base_rows.column("vector").combine_chunks(), self.dim), self.metric)
        ids = base_rows.column("id").to_numpy()[here]
        if marks is None:
            for part in _slices(len(ids), 1000):  # the first slice bounds the others
                self.best.add(ids[part], vectors[part])
        else:
            for cell, rows in _by_cell(base_rows.column("cell").to_numpy()[here]):
                self.best.add(ids[rows], vectors[rows], np.flatnonzero(marks[self.at, cell - begin]))

    def found(self) -> pa.Table:
        return pa.Table.from_batches([_result_batch(self.names, self.schema, self.ids, self.best.rows)])


def _by_cells(index: Index, queries, k, names, schema, chunk_rows, nprobe) -> DataFrame:
    base, pivots, metric, dim = index.rows, index.pivots, index.metric, index.dim
    if not len(pivots):
        return base.sparkSession.createDataFrame([], schema)
    queries = settle(_assigned(queries, pivots, metric, dim), "knn-queries")
    bundles, arrow_schema, count = Bundles.of(index.sizes, chunk_rows), _arrow_schema(schema), queries.count()
    rows = base.select("id", "vector", "cell", "seq")
    begin = lambda query_rows: _Meeting(query_rows, k, metric, dim, names, arrow_schema)
    if nprobe is not None:
        return _marked_met(rows, queries, count, _nearest_cells(pivots, min(nprobe, len(pivots))), index.sizes, bundles, chunk_rows, dim, metric, begin, schema)

    # The home bundle of a query gives real rows, hence an upper bound on its k-th
    # distance; the other cells are searched only if they can beat that bound.
    at_home = bundles.with_bundle(queries).select("id", "vector", "seq", "bundle", F.lit(None).cast("binary").alias("marks"))
    home = settle(_ranked(_met(rows, at_home, bundles, chunk_rows, begin, schema), k).drop("rank"), "knn-home")
    bounds = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("bound"))
    bounds = bounds.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    bounded = queries.join(bounds, "id", "left")
    return home.unionByName(_marked_met(rows, bounded, count, _reachable_cells(index, bundles), index.sizes, bundles, chunk_rows, dim, metric, begin, schema))


def _marked_met(base, rows, count: int, cells_of, sizes: np.ndarray, bundles: Bundles, chunk_rows, dim, metric, begin, schema) -> DataFrame:
    """``count`` queries with the cells that ``cells_of`` marks for them: sent there, or read beside them where sending would grow with the square."""
    if sizes.sum() > _SENT * chunk_rows and count > chunk_rows:
        return _met_in_place(base, rows, cells_of, bundles, dim, metric, begin, schema)
    return _met(base, _exploded(rows, cells_of, len(sizes), dim, metric, bundles), bundles, chunk_rows, begin, schema)


def _exploded(rows: DataFrame, cells_of, cells: int, dim: int, metric: str, bundles: Bundles) -> DataFrame:
    """One row per query and bundle with a cell that ``cells_of(vectors, batch)`` marks, and the marks of the bundle's cells as bits."""
    kept = [c for c in ("id", "vector", "seq", "bound") if c in rows.columns]
    schema = T.StructType(
        [*(rows.schema[c] for c in kept), T.StructField("bundles", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.BinaryType()))]
    )
    first = bundles.first

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, vectors = _prepared(np.arange(batch.num_rows), _vectors(batch.column("vector"), dim), metric)
            asked, bits = [], []
            for part in _slices(len(vectors), cells):
                marks = cells_of(vectors[part], batch.slice(part.start, len(vectors[part])))
                packed = [np.packbits(marks[:, a:b], axis=1) for a, b in zip(first[:-1], first[1:], strict=True)]
                some = np.stack([p.any(axis=1) for p in packed], axis=1)
                for i, row in enumerate(some):
                    asked.append(np.flatnonzero(row))
                    bits.append([packed[b][i].tobytes() for b in asked[-1]])
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(asked, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.binary()))], names=[*kept, "bundles", "bits"])

    # Stored before the explode: the marks are needed to count and again to join.
    marked_rows = settle(rows.mapInArrow(mark, schema), "knn-marked")
    each = marked_rows.select(*kept, F.explode(F.arrays_zip("bundles", "bits")).alias("asked"))
    return each.select(*kept, F.col("asked.bundles").alias("bundle"), F.col("asked.bits").alias("marks"))


def _probes(queries: DataFrame, pivots: np.ndarray, metric: str, dim: int, count: int, bundles: Bundles) -> DataFrame:
    return _exploded(queries, _nearest_cells(pivots, count), len(pivots), dim, metric, bundles)


def _nearest_cells(pivots: np.ndarray, count: int) -> Callable:
    def nearest(vectors: np.ndarray, _batch) -> np.ndarray:
        gaps = _gaps(vectors, pivots)
        order = np.argsort(gaps, axis=1, kind="stable")[:, :count]
        marked = np.zeros(gaps.shape, dtype=bool)
        np.put_along_axis(marked, order, True, axis=1)
        return marked

    return nearest


def _reachable_cells(index: Index, bundles: Bundles) -> Callable:
    """For queries every cell outside their own bundle that may hold a row within their bound.

    A row of cell j is no nearer than ``gap_j - radius_j`` (triangle inequality),
    and no nearer than the plane halfway between the two pivots.
    """
    pivots, radii, metric, longest = index.pivots, index.radii, index.metric, index.longest
    between = _gaps(pivots, pivots)
    bundle = np.repeat(np.arange(len(bundles.chunks)), np.diff(bundles.first))

    def within(vectors: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        own = batch.column("cell").to_numpy()
        bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
        bound = np.where(np.isnan(bound), np.inf, bound)
        if metric == "cosine":
            bound = np.sqrt(2.0 * np.maximum(bound, 0.0))
        elif metric == "dot":  # of lifted vectors, all as long as the longest
            square = (vectors * vectors).sum(axis=1) + longest
            bound = np.sqrt(np.maximum(square + 2.0 * bound, 0.0)) + 1e-6 * (1.0 + np.sqrt(square))
        gaps = _gaps(vectors, pivots)
        mine = gaps[np.arange(len(gaps)), own][:, None]
        apart = between[own]
        plane = (gaps**2 - mine**2) / (2.0 * np.where(apart > 0, apart, np.inf))
        slack = 1e-5 * (1.0 + gaps)
        reach = np.maximum(gaps - radii[None, :], plane) <= bound[:, None] + slack
        reach &= np.isfinite(radii)[None, :]
        return reach & (bundle[None, :] != bundle[own][:, None])

    return within
