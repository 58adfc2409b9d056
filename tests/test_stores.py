"""Stored partial aggregates, slots, lasting ids, mail threads, agreed answers and the quantised index."""

import os
import random
import time
import urllib.parse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketlens.catalogue import tables
from ticketlens.operators import append, quantized, threads, update
from ticketlens.operators.knn import Side, knn
from ticketlens.plans import partials, replies, ticket_reports
from ticketlens.sources import slots


def plan_of(df):
    return df._jdf.queryExecution().toString()


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# --- partial aggregates --------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows = [(f"s{i % 5}", rng.choice([None, rng.random() ** 2 * 1.2])) for i in range(20_000)]
    return spark.createDataFrame(rows, "source string, churn double").repartition(6)


def test_merged_partials_equal_the_report_within_the_rank_error(spark, scored):
    batches = [partials.churn_partials(scored.where(f"hash(churn) % 3 = {i}"), ["source"], size=256) for i in (-2, -1, 0, 1, 2)]
    store = batches[0]
    for batch in batches[1:]:
        store = store.union(batch)
    got, expected = partials.churn_kpis_of(store).first(), ticket_reports.churn_kpis(scored).first()
    assert (got["high_risk_count"], got["total_tickets"]) == (expected["high_risk_count"], expected["total_tickets"])
    assert got["avg_risk"] == pytest.approx(expected["avg_risk"])
    risk = scored.select(F.least(F.lit(1.0), "churn").alias("r")).where("r is not null and churn is not null")
    rank = risk.agg(F.avg((F.col("r") <= got["p90_risk"]).cast("int"))).first()[0]
    assert abs(rank - 0.9) <= partials.rank_error(256) + 1e-3
    by_source = {r["source"]: r for r in partials.churn_kpis_of(store, ["source"]).collect()}
    for row in scored.groupBy("source").count().collect():
        assert by_source[row["source"]]["total_tickets"] == row["count"]


def test_partials_of_nothing_and_of_unscored(spark, scored):
    empty = partials.churn_kpis_of(partials.churn_partials(scored.where("false"), [])).first()
    assert empty["avg_risk"] is None and empty["p90_risk"] is None and not empty["total_tickets"]
    unscored = partials.churn_kpis_of(partials.churn_partials(scored.where("churn is null"), ["source"])).first()
    assert unscored["avg_risk"] is None and unscored["p90_risk"] is None and unscored["total_tickets"] > 0


def test_a_report_of_partials_reads_no_scores(spark, scored, tmp_path):
    scored.write.parquet(f"{tmp_path}/scores")
    store = partials.churn_partials(spark.read.parquet(f"{tmp_path}/scores"), ["source"])
    assert "partial_kll_sketch_agg_double" in executed(store)
    store.write.parquet(f"{tmp_path}/partials")
    plan = plan_of(partials.churn_kpis_of(spark.read.parquet(f"{tmp_path}/partials")))
    assert "partials" in plan and "/scores" not in plan


# --- slots -----------------------------------------------------------------------


def files_of(spark, name):
    return {urllib.parse.unquote(f.removeprefix("file:").replace("//", "/")): os.stat(urllib.parse.unquote(f.removeprefix("file:").replace("//", "/"))).st_mtime_ns for f in spark.table(name).inputFiles()}


def test_an_update_rewrites_only_touched_slots(spark):
    rows = spark.range(2000).selectExpr("id AS k", "CAST(id AS string) AS a", "id * 2 AS b")
    slots.write_slots(rows, "slotted", "k", slots=16, buckets=2)
    before = files_of(spark, "slotted")
    new = spark.createDataFrame([(5, "five"), (77, None), (99_999, "nobody"), (None, "x")], "k long, a string")
    touched = slots.keyed_update_slots(spark, "slotted", new, ["a"])
    after = files_of(spark, "slotted")
    apart = lambda files: {f: t for f, t in files.items() if int(f.split("slot=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 3 and apart(before) == apart(after) and len(apart(before)) > len(before) / 2
    assert set(before) - set(apart(before)) != set(after) - set(apart(after))
    expected = update.keyed_update(rows, new, "k", ["a"])
    got = spark.table("slotted").drop("slot")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    assert slots.keyed_update_slots(spark, "slotted", new.where("false"), ["a"]) == []
    with pytest.raises(update.DuplicateKeyError):
        slots.keyed_update_slots(spark, "slotted", spark.createDataFrame([(1, "a"), (1, "b")], "k long, a string"), ["a"])
    spark.sql("DROP TABLE slotted")


def test_the_stored_side_of_an_update_is_not_shuffled(spark):
    slots.write_slots(spark.range(500).selectExpr("id AS k", "id AS v"), "slotted_plan", "k", slots=4, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = executed(update.keyed_update(spark.table("slotted_plan"), spark.range(9).selectExpr("id AS k", "-id AS v"), "k", ["v"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    left = plan.split("== Initial Plan ==")[0].split("slotted_plan")[0]
    assert "Bucketed: true" in plan and left.count("Exchange") <= 1
    spark.sql("DROP TABLE slotted_plan")


# --- ids -------------------------------------------------------------------------


def test_ids_stay_when_rows_are_appended(spark):
    numbered = spark.createDataFrame([(1, "a", "x", 10), (2, "b", None, 20), (7, None, "z", 30)], "ticket_id long, s string, k string, v long")
    rows = [("b", None, 99), ("0", "first", 1), (None, "z", 5), ("c", None, 3), ("c", None, 2), ("a", "x", 11), (None, None, 4)]
    found = append.append_ids(numbered, spark.createDataFrame(rows, "s string, k string, v long").repartition(3), ["s", "k"])
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])
    assert got[:3] == [(1, "a", "x", 10), (2, "b", None, 20), (7, None, "z", 30)]
    assert got[3:] == [(8, None, None, 4), (9, "0", "first", 1), (10, "c", None, 2)]
    again = append.append_ids(found, spark.createDataFrame(rows, "s string, k string, v long"), ["s", "k"])
    assert again.count() == 6
    assert append.append_ids(numbered.where("false"), numbered.drop("ticket_id"), ["s", "k"]).agg(F.max("ticket_id")).first()[0] == 3


def test_a_bloom_filter_loses_none_and_drops_most(spark):
    held = spark.range(3000).selectExpr("id", "CAST(id AS string) AS name")
    words = append.bloom_filter(held, ["id", "name"], 3000)
    others = spark.range(100_000, 160_000).selectExpr("id", "CAST(id AS string) AS name")
    assert append.may_hold(held, ["id", "name"], words).count() == 3000
    assert append.may_hold(others, ["id", "name"], words).count() < 1200
    assert "Exchange" not in plan_of(append.may_hold(others, ["id", "name"], words))


# --- threads ---------------------------------------------------------------------


def test_quotes_and_disclaimers_go_by_data(spark):
    legal, sign = "This message is confidential and for you only.", "Ada of the friendly team"
    mails = [
        (1, "t1", "ada", 1, f"My lamp is broken again.\nYes.\n{sign}\n{legal}"),
        (2, "t1", "bob", 2, "Please send a photo of it.\nYes.\n> My lamp  is BROKEN again."),
        (3, "t1", "ada", 3, f"Here is the photo of it.\n>> Please send a photo of it.\n{sign}\n{legal}"),
        (4, "t2", "ada", 4, f"A question on my invoice.\n{sign}\n{legal}"),
        (5, "t3", "eve", 5, f"{legal}\nAnother matter entirely."),
        (6, None, None, 6, f"My lamp is broken again.\n{sign}"),
        (7, "t1", "bob", None, None),
    ]
    table = spark.createDataFrame(mails, "id long, thread string, sender string, sent long, text string").repartition(3)
    got = {r["mail"]: tuple(r)[1:] for r in threads.without_repeats(table, "id", "thread", "sender", "sent", "text").collect()}
    assert got == {
        1: ("My lamp is broken again.\nYes.", 2, 0), 2: ("Please send a photo of it.\nYes.", 0, 1), 3: ("Here is the photo of it.", 2, 3),
        4: ("A question on my invoice.", 2, 0), 5: (f"{legal}\nAnother matter entirely.", 0, 0), 6: (f"My lamp is broken again.\n{sign}", 0, 0), 7: ("", 0, 0),
    }
    assert threads.without_repeats(table.where("false"), "id", "thread", "sender", "sent", "text").count() == 0
    plan = plan_of(threads.without_repeats(table, "id", "thread", "sender", "sent", "text"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# --- answers ---------------------------------------------------------------------


def test_the_middle_answer_and_contradictions(spark):
    found = [
        (1, 1, "reset the router now"), (1, 2, "reset the router now please"), (1, 3, "buy flowers"),
        (2, 1, "turn it on"), (2, 2, "send everything back"), (2, 3, "wait two weeks"), (3, 1, "only one"), (4, 1, "  "), (5, 1, "12"), (5, 2, "34"),
    ]
    table = spark.createDataFrame([(q, r, 0.1, a, "s", "b") for q, r, a in found], "query_id long, rank long, distance double, answer string, subject string, body string")
    got = {r["query_id"]: tuple(r)[1:] for r in replies.agreed_answers(table).collect()}
    assert got[1] == ("reset the router now", 1, 3, 0.5) and got[2][3] == 0.0 and got[3] == ("only one", 1, 1, 1.0) and 4 not in got
    assert got[5] == ("12", 1, 2, 1.0)
    contact = replies.Contact("a@b.c", "1")
    issues = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    asked = {r["query_id"]: (r["reply"], r["asked"]) for r in replies.agreed_or_asked(issues, table, "id", contact).collect()}
    assert asked[1] == ("reset the router now", False) and asked[2] == (contact.message(), True) and asked[6] == (contact.message(), True)


# --- the quantised index -----------------------------------------------------------


def test_promised_recall_at_sf01(spark, tmp_path):
    side = Side(tables.image_vectors(spark, "/root/testdata/sf0.1"), "vec_id", "embedding")
    index = quantized.build_quantized_index(side, str(tmp_path / "index"), k=10, recall=0.95)
    found, true = quantized.search_quantized(index, side, 10), knn(side, side, 10)
    both = found.join(true, ["query_id", "base_id"], "left_semi").count()
    assert both >= 0.9 * true.count() and index.rows.count() == side.df.count()
    assert len(os.listdir(tmp_path / "index")) > 20
    far = found.join(true.withColumnRenamed("distance", "d"), ["query_id", "base_id"]).where("abs(d - distance) > 1e-9")
    assert far.count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_clustered_vectors_take_few_probes(spark, tmp_path, metric):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24)) * 8
    rows = [(i, (centres[i % 30] + rng.normal(size=24)).tolist()) for i in range(3000)] + [(5000, None), (5001, [float("nan")] * 24)]
    side = Side(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), "id", "v")
    index = quantized.build_quantized_index(side, str(tmp_path / "index"), metric, cells=30, parts=8, cell_rows=40)
    assert index.recall >= 0.95 and index.probes <= 6 and index.rows.count() == 3000
    queries = Side(side.df.where("id % 50 = 0"), "id", "v")
    found, true = quantized.search_quantized(index, queries, 5), knn(side, queries, 5, metric)
    assert found.join(true, ["query_id", "base_id"], "left_semi").count() >= 0.9 * true.count()
    assert "vector" not in plan_of(index.rows.select("id", "code", "cell")).split("ReadSchema")[-1]


def test_an_index_of_nothing_and_of_few(spark, tmp_path):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    index = quantized.build_quantized_index(Side(few, "id", "v"), str(tmp_path / "few"), k=2)
    got = quantized.search_quantized(index, Side(few, "id", "v"), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["base_id"]) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 1)]
    none = Side(few.where("false"), "id", "v")
    assert quantized.search_quantized(quantized.build_quantized_index(none, str(tmp_path / "none")), Side(few, "id", "v"), 2).count() == 0
    with pytest.raises(ValueError):
        quantized.build_quantized_index(none, str(tmp_path / "dot"), "dot")


def test_repeated_ids_count_for_each_of_their_rows(spark, tmp_path):
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    side = Side(spark.createDataFrame(rows + rows[:1], "id long, v array<double>"), "id", "v")
    index = quantized.build_quantized_index(side, str(tmp_path / "twice"), k=3, cells=2)
    got = {(r["query_id"], r["rank"]): r["base_id"] for r in quantized.search_quantized(index, side, 3).collect()}
    assert [got[0, r] for r in (1, 2, 3)] == [0, 0, 0] and [got[9, r] for r in (1, 2, 3)] == [9, 8, 10]


def test_estimates_are_products_and_only_the_best_are_measured():
    """Every pair was looked up part by part and all of a query's estimates were ordered: some 100 ns a pair, where a product takes a few."""
    rng = np.random.default_rng(4)
    centres, books = rng.normal(size=(8, 32)) * 3, [rng.normal(size=(256, 2)) for _ in range(16)]
    cells, codes = rng.integers(0, 8, 40_000), rng.integers(0, 256, (40_000, 16)).astype(np.uint8)
    stands_for = centres[cells] + np.concatenate([book[codes[:, j]] for j, book in enumerate(books)], axis=1)
    base, queries = stands_for + rng.normal(size=stands_for.shape) * 0.1, rng.normal(size=(600, 32)) * 3
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    base_rows = pa.table({"id": np.arange(40_000), "vector": lists(base), "code": [c.tobytes() for c in codes], "cell": cells})
    schema = pa.schema([("query_id", pa.int64()), ("base_id", pa.int64()), ("distance", pa.float64())])
    marks = rng.random((600, 8)) < 0.6
    marks[0] = False
    met = quantized._Estimated(pa.table({"id": np.arange(600), "vector": lists(queries)}), (centres, books), 5, 20, "euclidean", 32, schema)
    start = time.perf_counter()
    met.look(base_rows, 0, marks)
    took = time.perf_counter() - start
    got = {}
    for r in met.found().to_pylist():
        got.setdefault(r["query_id"], []).append((r["base_id"], r["distance"]))
    assert 0 not in got and all(len(got.get(q, [])) == 5 for q in range(600) if marks[q].any())
    for q in (1, 250, 599):
        probed = np.flatnonzero(marks[q][cells])
        best = probed[np.argsort(((queries[q] - stands_for[probed]) ** 2).sum(axis=1))[:20]]
        exact = np.round(np.sqrt(((queries[q] - base[best]) ** 2).sum(axis=1)), 12)
        assert [i for i, _ in got[q]] == best[np.lexsort((best, exact))[:5]].tolist()
    assert took / (600 * 40_000) < 60e-9


def test_least_of_many_of_few_and_of_equal_numbers():
    rng = np.random.default_rng(6)
    for n, count in ((50, 7), (5_000, 40), (40_000, 40), (20_000, 2_500)):
        numbers = rng.normal(size=(12, n)).astype(np.float32)
        numbers[3], numbers[4, 5:], numbers[5], numbers[7, n // 2 :] = np.inf, np.inf, 1.0, np.inf
        numbers[6, :: max(1, n // 2048)] = 9.0  # those that are looked at first are the greatest
        for row, found in zip(numbers, quantized._least(numbers, count), strict=True):
            found = found[found >= 0]
            assert len(set(found)) == len(found) and np.array_equal(np.sort(row[found]), np.sort(row[np.isfinite(row)])[:count])


def test_queries_and_codes_meet_in_stored_blocks(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)))]
    side = Side(spark.createDataFrame(rows + [(5000, None)], "id long, v array<double>").repartition(3), "id", "v")
    index = quantized.build_quantized_index(side, str(tmp_path / "index"), cell_rows=120, k=5, recall=0.9)
    found, true = quantized.search_quantized(index, side, 5), knn(side, side, 5)
    plan = plan_of(found)
    assert "CartesianProduct" in plan and "FlatMapCoGroupsInArrow" not in plan
    assert found.count() == true.count() == 7500 and found.join(true, ["query_id", "base_id"], "left_semi").count() >= 0.85 * 7500
