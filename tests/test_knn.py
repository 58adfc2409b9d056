"""Nearest neighbours against brute force, on every path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import knn as knn_module
from ticketlens.operators.knn import METRICS, Bundles, Side, _probes, build_index, distance_to, fit_centroids, knn, nearest_to_vector


def frame(spark, vectors, name):
    return spark.createDataFrame([(f"{name}{i:05d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, v array<double>")


def brute(base, queries, k, metric):
    b, q = np.asarray(base, float), np.asarray(queries, float)
    if metric == "euclidean":
        d = np.sqrt(((q[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    elif metric == "dot":
        d = -(q @ b.T)
    else:
        d = 1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    d = np.round(d, 9) + 0.0
    return {
        f"q{i:05d}": [(f"b{j:05d}", d[i, j]) for j in sorted(range(len(b)), key=lambda j: (d[i, j], j))[:k]]
        for i in range(len(q))
    }


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["base_id"], round(r["distance"], 9) + 0.0))
    return got


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 10
    base = np.concatenate([c + rng.normal(size=(40, 8)) for c in centres])
    base[::3] = base[0]  # a third of the rows are copies of one
    queries = np.concatenate([centres + 0.1, base[5:25]])
    return base, queries


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("options", [{}, {"broadcast_queries": 0, "chunk_rows": 50}, {"broadcast_bytes": 1, "cells": 5}], ids=["broadcast", "cells", "few cells"])
def test_equals_brute_force(spark, clustered, metric, options):
    base, queries = clustered
    sides = Side(frame(spark, base, "b").repartition(5), "id", "v"), Side(frame(spark, queries, "q").repartition(3), "id", "v")
    assert found(knn(*sides, 7, metric, **options)) == brute(base, queries, 7, metric)


@pytest.mark.parametrize("metric", METRICS)
def test_an_index_serves_several_searches(spark, clustered, metric):
    base, queries = clustered
    index = build_index(Side(frame(spark, base, "b"), "id", "v"), metric, cells=9)
    for asked in (queries, queries[:3]):
        side = Side(frame(spark, asked, "q"), "id", "v")
        assert found(knn(index, side, 4, chunk_rows=40)) == brute(base, asked, 4, metric)
    with pytest.raises(ValueError, match="length 3"):
        knn(index, Side(frame(spark, np.eye(3), "q"), "id", "v"), 1)


def test_broadcast_queries_over_many_tasks(spark):
    """More base rows than those that bound the distances."""
    rng = np.random.default_rng(4)
    base, queries = rng.normal(size=(4000, 8)), rng.normal(size=(5, 8))
    sides = Side(frame(spark, base, "b").repartition(40), "id", "v"), Side(frame(spark, queries, "q"), "id", "v")
    for metric in METRICS:
        assert found(knn(*sides, 10, metric)) == brute(base, queries, 10, metric)


def test_k_beyond_the_base(spark):
    base, queries = np.eye(3), np.eye(3)[:2]
    sides = Side(frame(spark, base, "b"), "id", "v"), Side(frame(spark, queries, "q"), "id", "v")
    for options in ({}, {"broadcast_queries": 0}):
        assert found(knn(*sides, 10, **options)) == brute(base, queries, 10, "euclidean")


def test_unusable_vectors_take_no_part(spark):
    schema = "id string, v array<double>"
    base = spark.createDataFrame(
        [("ok", [1.0, 0.0]), ("null", None), ("hole", [1.0, None]), ("nan", [1.0, float("nan")]), ("zero", [0.0, 0.0])],
        schema,
    )
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0]), ("none", None)], schema)
    for options in ({}, {"broadcast_queries": 0}):
        got = found(knn(Side(base, "id", "v"), Side(queries, "id", "v"), 5, "cosine", **options))
        assert got == {"q": [("ok", 0.0)], "r": [("ok", 1.0)]}
        got = found(knn(Side(base, "id", "v"), Side(queries, "id", "v"), 1, **options))
        assert got == {"q": [("ok", 0.0)], "r": [("zero", 1.0)]}


@pytest.mark.parametrize("options", [{}, {"broadcast_queries": 0}])
def test_vectors_of_other_lengths_are_an_error(spark, options):
    schema = "id string, v array<double>"
    flat, deep = ([("a", [1.0, 0.0])], [("a", [1.0, 0.0]), ("b", [1.0])])
    with pytest.raises(ValueError, match="lengths from 1 to 2"):
        knn(Side(spark.createDataFrame(flat, schema), "id", "v"), Side(spark.createDataFrame(deep, schema), "id", "v"), 1, **options)
    with pytest.raises(Exception, match="a vector of length 1, not 2"):
        knn(Side(spark.createDataFrame(deep, schema), "id", "v"), Side(spark.createDataFrame(flat, schema), "id", "v"), 1, **options).collect()


def test_no_queries_and_no_base(spark):
    empty = frame(spark, [], "x")
    some = frame(spark, np.eye(2), "b")
    for options in ({}, {"broadcast_queries": 0}):
        assert knn(Side(some, "id", "v"), Side(empty, "id", "v"), 3, **options).count() == 0
        assert knn(Side(empty, "id", "v"), Side(some, "id", "v"), 3, **options).count() == 0


@pytest.mark.parametrize("metric", METRICS)
def test_one_vector(spark, clustered, metric):
    base, _ = clustered
    target = base[1] + 0.5
    got = nearest_to_vector(frame(spark, base, "b"), target.tolist(), 9, "id", "v", metric)
    expected = brute(base, [target], 9, metric)["q00000"]
    assert [(r["id"], round(r["distance"], 9)) for r in got.collect()] == expected


def test_one_vector_skips_unusable_rows(spark):
    base = spark.createDataFrame([("a", [1.0, None]), ("b", None), ("c", [1.0]), ("d", [0.0, 0.0])], "id string, v array<double>")
    assert [r["id"] for r in nearest_to_vector(base, [1.0, 1.0], 5, "id", "v").collect()] == ["d"]


def test_unknown_metric(spark):
    side = Side(frame(spark, np.eye(2), "b"), "id", "v")
    with pytest.raises(ValueError):
        knn(side, side, 1, "manhattan")
    with pytest.raises(ValueError):
        distance_to(F.col("v"), [1.0], "manhattan")


def test_probing_finds_most_neighbours_of_clustered_vectors(spark, clustered):
    base, queries = clustered
    sides = Side(frame(spark, base, "b"), "id", "v"), Side(frame(spark, queries, "q"), "id", "v")
    exact = brute(base, queries, 5, "euclidean")
    got = found(knn(*sides, 5, centroids=fit_centroids(sides[0], 12), nprobe=2))
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in exact.items())
    assert hits / (5 * len(queries)) > 0.9
    everything = knn(*sides, 5, cells=6, nprobe=100)
    assert found(everything) == exact


def test_a_query_is_sent_once_to_all_the_cells_of_a_block(spark):
    """It was sent to each of the cells it might meet, some hundreds in a large table."""
    rng = np.random.default_rng(5)
    base = Side(frame(spark, rng.normal(size=(600, 16)), "b"), "id", "v")
    index = build_index(base, cells=60)
    bundles = Bundles.of(index.sizes, 200)
    assert index.sizes.sum() == 600 and len(bundles.chunks) <= 6 and bundles.first[-1] == len(index.pivots)
    probed = _probes(index.rows, index.pivots, "euclidean", 16, 40, bundles)
    marks = [(r["id"], r["bundle"], r["marks"]) for r in probed.collect()]
    assert len(marks) == len({m[:2] for m in marks}) <= 600 * len(bundles.chunks)
    assert sum(b.bit_count() for _, _, bits in marks for b in bits) == 600 * 40
    queries = rng.normal(size=(30, 16))
    near = knn(index, Side(frame(spark, queries, "q"), "id", "v"), 3, chunk_rows=200, nprobe=len(index.pivots))
    assert found(near) == found(knn(base, Side(frame(spark, queries, "q"), "id", "v"), 3))


def test_a_cell_larger_than_a_block_is_a_bundle_in_chunks():
    bundles = Bundles.of(np.array([3, 0, 25, 4, 4, 4]), 10)
    assert bundles.first.tolist() == [0, 2, 3, 5, 6] and bundles.chunks.tolist() == [1, 3, 1, 1]


@pytest.mark.parametrize("metric", knn_module.METRICS)
def test_most_pairs_are_ruled_out_in_single_precision(metric, monkeypatch):
    rng, doubled = np.random.default_rng(5), []
    queries, base = rng.normal(size=(700, 16)), rng.normal(size=(6000, 16))
    rough = knn_module._rough
    monkeypatch.setattr(knn_module, "_rough", lambda a, b, m: (doubled.append(len(a) * len(b)), rough(a, b, m))[1])
    best = knn_module._Best(queries, 5, metric)
    for i in range(0, 6000, 1000):
        best.add(np.arange(i, i + 1000), base[i : i + 1000])
    assert len(best.rows) == 5 * 700
    assert sum(doubled) < 0.2 * 700 * 6000


@pytest.mark.parametrize("metric", knn_module.METRICS)
@pytest.mark.parametrize("kind", ["plain", "tiny", "huge", "beyond", "mixed", "far", "copies", "zeros"])
def test_neighbours_of_vectors_of_any_length(metric, kind):
    rng = np.random.default_rng(6)
    queries, base = rng.normal(size=(90, 9)), rng.normal(size=(1300, 9))
    if kind in ("tiny", "huge", "beyond"):
        scale = {"tiny": 1e-30, "huge": 1e7, "beyond": 1e40}[kind]
        queries, base = queries * scale, base * scale
    elif kind == "mixed":
        queries, base = (x * 10.0 ** rng.integers(-9, 9, size=(len(x), 1)) for x in (queries, base))
    elif kind == "far":
        queries, base = 1e5 + queries, 1e5 + base
    elif kind == "copies":
        base[200:1200], queries[:40] = base[0], base[0]
    elif kind == "zeros" and metric != "cosine":
        base[:600] = 0.0
    (_, queries), (ids, base) = (knn_module._prepared(np.arange(len(x)), x, metric) for x in (queries, base))
    asked = [None if i % 2 else np.flatnonzero(rng.random(len(queries)) < share) for i, share in enumerate((0.3, 0, 0.8, 0))]
    best = knn_module._Best(queries, 4, metric)
    seen = np.zeros((len(queries), len(base)), bool)
    for part, some in zip(np.array_split(ids, 4), asked, strict=True):
        best.add(part, base[part], some)
        seen[np.ix_(np.arange(len(queries)) if some is None else some, part)] = True
    got = [(r.q, r.id, r.d) for r in best.rows.sort_values(["q", "d", "id"]).itertuples()]
    want = []
    for q in range(len(queries)):
        at = np.flatnonzero(seen[q])
        d = knn_module._exact(np.broadcast_to(queries[q], (len(at), 9)), base[at], metric)
        want += [(q, int(at[i]), d[i]) for i in np.lexsort((at, d))[:4]]
    assert got == want


@pytest.mark.parametrize("metric", METRICS)
def test_blocks_are_read_where_they_are_compared(spark, clustered, metric):
    """Queries and base rows were sent to each other: to each block a copy of nearly all, so that shuffles grew with the square."""
    base, rng = clustered[0], np.random.default_rng(8)
    queries = np.concatenate([base[5:25], rng.normal(size=(130, 8)) * 10])
    sides = Side(frame(spark, base, "b").repartition(5), "id", "v"), Side(frame(spark, queries, "q").repartition(3), "id", "v")
    near = knn(*sides, 7, metric, broadcast_queries=0, chunk_rows=60)
    plan = plan_of(near)
    assert plan.count("CartesianProduct") == 1 and "FlatMapCoGroupsInArrow" not in plan
    true = brute(base, queries, 7, metric)
    for got in (found(near), found(knn(*sides, 7, metric, chunk_rows=60, nprobe=500))):
        assert got.keys() == true.keys()
        for q, rows in true.items():
            assert [i for i, _ in got[q]] == [i for i, _ in rows] and np.allclose([d for _, d in got[q]], [d for _, d in rows])


def test_each_row_is_stored_in_one_block(spark, monkeypatch):
    rng, kept = np.random.default_rng(9), {}
    settle = knn_module.settle
    monkeypatch.setattr(knn_module, "settle", lambda df, name, **options: kept.setdefault(name, settle(df, name, **options)))
    monkeypatch.setattr(knn_module, "_ASKED", 100)
    side = Side(frame(spark, rng.normal(size=(900, 16)), "q"), "id", "v")
    assert knn(side, side, 3, broadcast_queries=0, chunk_rows=50).count() == 2700
    for name, ids, vectors in (("knn-query-blocks", "ids", "vectors"), ("knn-base-blocks", "base_ids", "base_vectors")):
        blocks = kept[name].select(F.size(ids).alias("n"), F.octet_length(vectors).alias("bytes"), ids).collect()
        assert sum(b["n"] for b in blocks) == 900 and len({i for b in blocks for i in b[ids]}) == 900
        assert len(blocks) > 5 and all(b["bytes"] == b["n"] * 16 * 8 for b in blocks)


def test_blocks_with_whole_numbers_as_ids_and_ids_that_repeat(spark):
    rows = [(i, [float(i), 1.0]) for i in range(300)]
    side = Side(spark.createDataFrame(rows + rows[:1], "id long, v array<double>"), "id", "v")
    got = {(r["query_id"], r["rank"]): r["base_id"] for r in knn(side, side, 3, broadcast_queries=0, chunk_rows=20).collect()}
    assert [got[9, r] for r in (1, 2, 3)] == [9, 8, 10] and [got[200, r] for r in (1, 2, 3)] == [200, 199, 201]
