"""Learned types, priorities, scores and words: against plain versions, planted cases, and by plan."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.functions import classify, text
from ticketlens.operators import logistic, propagation, threads, weights
from ticketlens.operators.embedding import embed, hashed_words
from ticketlens.plans import churn, learned, moderation

TOPICS = {
    "Billing and Payments": "ledger statement dues sum owed balance receipt cents",
    "Technical Support": "screen flicker boot fan noise driver pixel heat",
    "Shipping & Returns": "parcel courier doorstep depot van label crate route",
    "Account & Access": "profile sign token nickname avatar settings email code",
}


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def topical(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        topic = rng.choice(sorted(TOPICS))
        words = rng.choices(TOPICS[topic].split(), k=12) + rng.choices("the a my is it now".split(), k=6)
        rng.shuffle(words)
        priority = {"Billing and Payments": "High", "Technical Support": "p1", "Shipping & Returns": "medium"}.get(topic, " LOW ")
        rows.append((i, "form" if i % 3 else "chat", topic, priority, " ".join(words[:3]), " ".join(words[3:])))
    rows += [(1000 + i, "chat", "?", None, "same words", "as ever again") for i in range(30)] + [(2000, "chat", "?", None, "", "123")]
    table = spark.createDataFrame(rows, "ticket_id long, source string, real string, priority string, subject string, body string")
    return embed(table, text.embedding_text("subject", "body"), hashed_words(256))


# --- propagation -------------------------------------------------------------


def test_types_of_tickets_that_taught_nothing_beat_the_keyword_rules(topical):
    tickets = topical.withColumn("type", F.col("real"))
    taught = (F.col("source") == "form") & (F.col("ticket_id") % 4 == 0)
    graph = learned.ticket_graph(tickets, k=5)
    found = learned.learn_types(tickets, graph, taught)
    held = tickets.where(~taught & (F.col("ticket_id") < 1000))
    hits = held.join(found.withColumnRenamed("type", "learned"), "ticket_id").agg(
        F.avg((F.col("learned") == F.col("real")).cast("int")),
        F.avg((classify.ticket_type(text.words(text.ticket_text())) == F.col("real")).cast("int")),
    ).first()
    assert hits[0] > 0.9 and hits[1] < 0.5
    ids = {r["ticket_id"]: r for r in found.collect()}
    assert len(ids) == 271 and ids[2000]["type"] == "Other" and ids[2000]["score"] == 0
    priorities = learned.learn_priorities(tickets, graph, taught)
    right = {"Billing and Payments": "high", "Technical Support": "high", "Shipping & Returns": "medium", "Account & Access": "low"}
    got = [(r["priority"], right[r["real"]]) for r in held.select("ticket_id", "real").join(priorities, "ticket_id").collect()]
    assert sum(a == b for a, b in got) > 0.9 * len(got)


def plain_propagation(edges, seeds, damping, rounds, labels):
    score = dict(seeds)
    nodes = {a for a, _, _ in edges} - set(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for a in nodes:
            mine = [(b, w) for x, b, w in edges if x == a]
            total = sum(w for _, w in mine)
            new[a] = {label: damping * sum(w * score.get(b, {}).get(label, 0) for b, w in mine) // (100 * total) for label in labels}
        if new == score:
            break
        score = new
    return score


@pytest.mark.parametrize("rounds", [0, 1, 4, None])
def test_propagation_equals_the_plain_one(spark, rounds):
    rng = random.Random(2)
    pairs = {(a, b): rng.randrange(1, 1000) for a in range(40) for b in rng.sample(range(40), 3) if a < b}
    edges = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()] + [(90, 91, 5), (91, 90, 5)]
    seeds = [(0, "x"), (1, "y"), (1, "y"), (1, "x"), (2, "z"), (None, "x"), (3, None)]
    found = propagation.propagate_labels(
        spark.createDataFrame(edges, "node long, neighbour long, weight long"), spark.createDataFrame(seeds, "node long, label string"),
        rounds=rounds, least=1, default="none",
    )
    fixed = {0: {"x": 1_000_000}, 1: {"x": 333_333, "y": 666_666}, 2: {"z": 1_000_000}}
    score = plain_propagation(edges, fixed, 80, 1000 if rounds is None else rounds, "xyz")
    expected = {}
    for node, by_label in score.items():
        label, best = min(((label, by_label.get(label, 0)) for label in "xyz"), key=lambda x: (-x[1], x[0]))
        expected[node] = (label if best else "none", best)
    assert {r["node"]: (r["label"], r["score"]) for r in found.collect()} == expected


def test_copies_are_one_node_and_edges_go_both_ways(topical):
    nodes, members = propagation.vector_nodes(topical, "ticket_id", "text_embedding")
    assert {r["node"] for r in members.where("id between 1000 and 1029").collect()} == {1000}
    edges = propagation.neighbour_edges(nodes, 4)
    pairs = {(r["node"], r["neighbour"]): r["weight"] for r in edges.collect()}
    assert all(pairs[b, a] == w and a != b and w > 0 for (a, b), w in pairs.items())


def test_no_seed_no_edge_and_too_many_labels(spark):
    edges = spark.createDataFrame([(1, 2, 3)], "node long, neighbour long, weight long")
    none = spark.createDataFrame([], "node long, label string")
    assert [tuple(r) for r in propagation.propagate_labels(edges, none, default="Other").collect()] == [(1, "Other", 0)]
    seed = spark.createDataFrame([(7, "x")], "node long, label string")
    assert [tuple(r) for r in propagation.propagate_labels(edges.where("false"), seed).collect()] == [(7, "x", 1_000_000)]
    with pytest.raises(ValueError):
        propagation.propagate_labels(edges, spark.range(300).selectExpr("id AS node", "'l' || id AS label"))


# --- logistic regression -----------------------------------------------------


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        words = rng.choices(["fine", "good", "order", "box", "day"], k=8) + rng.choices(["vile", "rude", "awful"] if bad else ["kind", "nice", "calm"], k=3)
        rows.append((i, " ".join(words), int(bad)))
    rows += [(900, None, 1), (901, "fine", None), (902, "fine", 7)]
    return spark.createDataFrame(rows, "id long, text string, label int").repartition(6)


def test_logistic_weights_equal_plain_gradient_steps(rated):
    dim, steps, rate, l2 = 64, 6, 2.0, 0.01
    model = logistic.fit_logistic(rated, "text", "label", dim=dim, steps=steps, rate=rate, l2=l2)
    rows = [r for r in rated.select("label", logistic.hashed_features(F.col("text"), dim).alias("f")).where("text is not null and label in (0, 1)").collect()]
    x = np.zeros((len(rows), dim + 1))
    for i, r in enumerate(rows):
        x[i, r["f"]["buckets"]] = r["f"]["values"]
    x[:, -1] = 1
    y = np.array([r["label"] for r in rows], float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = former = np.zeros(dim + 1)
    for t in range(steps):
        ahead = w + t / (t + 3) * (w - former)
        gradient = x.T @ ((1 / (1 + np.exp(-x @ ahead)) - y) * share)
        w, former = ahead - rate * (gradient + l2 * np.append(ahead[:-1], 0)), w
    assert np.allclose(w, model.weights, atol=1e-12)
    scored = rated.select("id", model(F.col("text")).alias("p")).collect()
    by_id = {r["id"]: r["p"] for r in scored}
    assert by_id[900] == pytest.approx(1 / (1 + math.exp(-w[-1])))


def test_logistic_tells_held_out_texts(rated):
    model = logistic.fit_logistic(rated.where("id % 3 != 0"), "text", "label", dim=4096, steps=20)
    held = rated.where("id % 3 = 0 and id < 900").select("label", (model(F.col("text")) > 0.5).cast("int").alias("p"))
    assert held.where("label != p").count() == 0


def test_a_tree_of_gradients_adds_up_to_their_sum(spark):
    parts = spark.range(100).selectExpr("id AS part").repartition(7).mapInPandas(
        lambda frames: (f.assign(gradient=[np.array([float(p), 1.0]).tobytes() for p in f["part"]]) for f in frames), "part long, gradient binary"
    )
    assert logistic.tree_sum(parts, 100, fan_in=4).tolist() == [4950.0, 100.0]
    assert logistic.tree_sum(parts.where("false"), 0) is None


def test_one_label_says_a_half(spark):
    table = spark.createDataFrame([("a", 1), ("b", 1)], "text string, label int")
    model = logistic.fit_logistic(table, "text", "label", dim=16)
    assert [r[0] for r in table.select(model(F.col("text"))).collect()] == [0.5, 0.5]


# --- words -------------------------------------------------------------------


def test_word_totals_are_the_same_by_both_ways_and_row_by_row(spark):
    rows = [(1, "Bad bad, good!"), (1, "bad"), (2, None), (3, ""), (4, "éclat Éclat nothing")]
    table = spark.createDataFrame(rows, "id long, text string")
    known = spark.createDataFrame([("bad", -1.0), ("good", 2.5), ("éclat", 0.25)], "word string, weight double")
    expected = sorted([(1, 0.5), (1, -1.0), (2, 0.0), (3, 0.0), (4, 0.5)])
    for most in (10, 0):
        found = weights.add_word_total(table, F.col("text"), known, "total", broadcast_words=most)
        assert sorted((r["id"], r["total"]) for r in found.collect()) == expected
    small = weights.add_word_total(table, F.col("text"), known, "total")
    assert "Exchange" not in plan_of(small) and "Join" not in plan_of(small)


def test_common_words_of_many_weights_are_not_joined(spark, monkeypatch):
    rows = [(i, "the the a rare%s" % "abcdefgh"[i % 8] + (" unknown" if i % 3 else "")) for i in range(40)] + [(1, None), (1, "")]
    table = spark.createDataFrame(rows, "id long, text string")
    known = spark.createDataFrame([("the", 0.5), ("a", 2.0)] + [(f"rare{c}", 4.0 + i) for i, c in enumerate("abcdefgh")], "word string, weight double")
    joined, explode = [], weights.settle
    monkeypatch.setattr(weights, "settle", lambda df, name: joined.append(explode(df, name)) or joined[-1])
    found = weights.add_word_total(table, F.col("text"), known, "total", broadcast_words=2)
    expected = [(i, 7.0 + i % 8) for i in range(40)] + [(1, 0.0), (1, 0.0)]
    assert sorted((r["id"], r["total"]) for r in found.collect()) == sorted(expected)
    left = joined[0].select(F.explode("counted.rest.word").alias("w")).distinct()
    assert {r["w"] for r in left.collect()} == {f"rare{c}" for c in "abcdefgh"} | {"unknown"}


def test_polarity_counts_are_those_of_all_pairs(spark):
    pool = ["good", "bad", "fine", "so", "à", "nice"]
    texts = [" ".join(pool[(i * j + j // 3) % 6] for j in range(i % 13)) for i in range(60)] + [None, "", "good", "good, GOOD-good"]
    expected = {}
    for text in texts:
        ws = re.findall(r"[^\W\d_]+", (text or "").lower())
        for i, w in enumerate(ws):
            if len(ws) < 2:
                continue
            others = [ws[j] for j in range(len(ws)) if j != i and abs(j - i) <= 3]
            one = expected.setdefault(w, [0, 0, 0])
            for k, x in enumerate((len(others), sum(o in ("good", "nice") for o in others), others.count("bad"))):
                one[k] += x
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["word"]: list(r)[1:4] for r in weights.induced_polarity(table, F.col("text"), ["good", "nice"], ["bad"], window=3).collect()}
    assert got == expected


def test_mails_are_cut_into_lines_once(spark):
    rows = [(1, "t", "s", "one first line\nkind regards"), (2, "t", "s", "> One  first line\nanother answer"), (3, None, None, None)]
    mails = spark.createDataFrame(rows, "id long, thread string, sender string, text string")
    found = threads.without_repeats(mails, "id", "thread", "sender", "id", "text")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["mail"], r["text"], r["n_quoted"]) for r in found.collect()) == [(1, "one first line\nkind regards", 0), (2, "another answer", 1), (3, "", 0)]


def test_rows_that_repeat_an_id_are_judged_alone(spark):
    labelled = spark.createDataFrame([("vile rude", 1), ("kind day", 0), ("kind nice", 0), ("nice day", 0)], "text string, label int")
    model = moderation.train_abuse_model(labelled, "text", "label")
    rows = spark.createDataFrame([(1, "vile kind day nice")] * 3, "id long, text string")
    assert [r["abusive"] for r in moderation.flag_abuse(rows, "id", "text", model).collect()] == [False] * 3


def test_cue_weights_by_hand(spark):
    table = spark.createDataFrame([("leave now leave", True), ("stay now", False), ("stay", False), (None, True), ("x", None)], "text string, gone boolean")
    got = {r["word"]: r for r in weights.cue_weights(table, F.col("text"), F.col("gone"), prior=6.0).collect()}
    x, y = 2 + 6 * 2 / 6, 0 + 6 * 2 / 6
    weight = math.log(x / (3 + 6 - x)) - math.log(y / (3 + 6 - y))
    assert got["leave"]["weight"] == pytest.approx(weight) and got["leave"]["z"] == pytest.approx(weight / math.sqrt(1 / x + 1 / y))
    assert got["now"]["weight"] == pytest.approx(0) and got["stay"]["weight"] == pytest.approx(-weight) and len(got) == 3
    one = spark.createDataFrame([("a a", True)], "text string, gone boolean")
    assert [r["weight"] for r in weights.cue_weights(one, F.col("text"), F.col("gone")).collect()] == [0.0]
    assert weights.cue_weights(one.where("false"), F.col("text"), F.col("gone")).count() == 0


def pooled(counts, hits):
    """Isotonic means by merging neighbours that fall."""
    blocks = []
    for i, (n, h) in enumerate(zip(counts, hits)):
        if n:
            blocks.append([h, n, [i]])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                h2, n2, at = blocks.pop()
                blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + n2, blocks[-1][2] + at]
    return {i: h / n for h, n, at in blocks for i in at}


def test_monotone_shares_equal_pooled_neighbours(spark):
    rng = random.Random(3)
    rows = [(b / 10 + 0.05, int(rng.random() < b / 14)) for b in range(12) for _ in range(rng.choice([0, 1, 3, 9]))] + [(None, 1), (0.5, None), (99.0, 1), (-1.0, 0)]
    table = spark.createDataFrame(rows, "score double, label int")
    shares = weights.fit_monotone(table, F.col("score"), F.col("label"), 0.1, 12)
    counts, hits = [0] * 12, [0] * 12
    for s, y in rows:
        if s is not None and y is not None:
            b = min(max(math.floor(s / 0.1), 0), 11)
            counts[b] += 1
            hits[b] += y
    for i, value in pooled(counts, hits).items():
        assert shares[i] == pytest.approx(value)
    assert shares == sorted(shares)
    assert weights.fit_monotone(table.where("false"), F.col("score"), F.col("label"), 0.1, 3) == [0.0] * 3


def test_risk_grows_with_cues_and_is_null_without_words(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        cues = rng.choice([0, 1, 4])
        rows.append((" ".join(rng.choices("order box day mail thing".split(), k=10) + ["goodbye"] * cues), rng.random() < (0.05, 0.4, 0.95)[cues // 2 if cues else 0]))
    model = churn.fit_churn(spark.createDataFrame(rows, "text string, gone boolean"), F.col("text"), F.col("gone"))
    assert {r["word"] for r in model.cues.collect()} == {"goodbye"}
    tickets = spark.createDataFrame([(1, "order box", "day mail thing"), (2, "goodbye", "goodbye goodbye goodbye order"), (3, None, "12 !")], "ticket_id long, subject string, body string")
    risk = {r["ticket_id"]: r["churn"] for r in churn.score_churn_weighted(tickets, model).collect()}
    assert 0 <= risk[1] < 0.5 < risk[2] <= 1 and risk[3] is None


def test_polarity_equals_plain_counts_and_reaches_unlisted_words(spark):
    texts = ["good tasty soup with bread", "good tasty rice", "bad stale bread here today now then good", "bad stale soup", "alone", None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["word"]: tuple(r)[1:4] for r in weights.induced_polarity(table, F.col("text"), ["good"], ["bad"], window=2).collect()}
    expected = {}
    for t in texts:
        ws = (t or "").split()
        for i, w in enumerate(ws):
            if len(ws) < 2:
                continue
            around = [ws[j] for j in range(max(0, i - 2), min(len(ws), i + 3)) if j != i]
            old = expected.get(w, (0, 0, 0))
            expected[w] = (old[0] + len(around), old[1] + around.count("good"), old[2] + around.count("bad"))
    assert got == expected
    polarity = churn.learn_polarity(table, F.col("text"), ["good"], ["bad"], window=2, least_pairs=2)
    by_word = {r["word"]: r["weight"] for r in polarity.collect()}
    assert by_word["tasty"] > 0 > by_word["stale"] and by_word["good"] >= 1 and by_word["bad"] <= -1
    tickets = spark.createDataFrame([(1, "tasty", "things"), (2, "stale", "things"), (3, None, None)], "ticket_id long, subject string, body string")
    moods = {r["ticket_id"]: r["sentiment"] for r in churn.score_sentiment_induced(tickets, polarity).collect()}
    assert moods == {1: "Positive", 2: "Negative", 3: "Neutral"}


def test_learning_joins_no_table_with_all_of_another(spark, topical):
    edges = spark.createDataFrame([(1, 2, 3)], "node long, neighbour long, weight long")
    seeds = spark.createDataFrame([(1, "x")], "node long, label string")
    plans = [plan_of(propagation.propagate_labels(edges, seeds, rounds=1)), plan_of(weights.cue_weights(topical, F.col("body"), F.col("source") == "form"))]
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan
