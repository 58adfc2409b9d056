"""Periodic runs, token counts at prefixes, and the trie of conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle_check import connect, difference
from ticketlens.llm import queries, runs, tokencounts, tries

SF = "/root/testdata/sf0.01"
LONG = "x " * 300_000 + "y" * 3_000_000


# --- runs --------------------------------------------------------------------


def plain_runs(words):
    found = []
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.append((i, j - i + q, q))
            i = j
    smaller = lambda s, n, q: any(words[s : s + n - p] == words[s + p : s + n] for p in range(1, q))
    return sorted((r for r in found if not smaller(*r)), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=25), st.integers(1, 12), st.integers(0, 30)), max_size=6), st.integers(0, 3))
def test_runs_equal_the_plain_scan(parts, copies):
    words = [w for block, times, cut in parts for w in (block * times)[: max(1, len(block) * times - cut)]]
    texts = [words] * (copies + 1) + [[], words[3:]]
    assert runs.find_runs(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("period, times", [(1, 24), (8, 3), (15, 4), (16, 3), (17, 3), (32, 3), (33, 5), (700, 3)])
def test_runs_of_every_scale_are_found_at_their_borders(period, times):
    block = [b"%d" % i for i in range(period)]
    words = [b"p", *(block * times), b"q"]
    assert runs.find_runs([words]) == [[(1, period * times, period)]]
    shorter = [b"p", *(block * times)[: max(24, 3 * period) - 1], b"q"]
    assert runs.find_runs([shorter]) == [[]]


def test_a_period_that_itself_repeats_words(spark, docs_of):
    inner = ["a"] * 30 + ["b"] + ["a"] * 30 + ["c"]
    text = " ".join(inner * 4)
    row = runs.periodic_runs(docs_of([(1, text)])).first()
    words = [w.encode() for w in inner * 4]
    assert [tuple(r) for r in row["runs"]] == plain_runs(words)
    assert (0, 248, 62) in [tuple(r) for r in row["runs"]]


def test_a_text_of_one_word_takes_few_steps():
    assert runs.find_runs([[b"x"] * 200_000]) == [[(0, 200_000, 1)]]
    assert runs.collapse([b"x"] * 30, [(0, 30, 1)]) == [b"x"]


def test_runs_of_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (None, "a " * 40), (5, "a " * 40), (5, "a " * 40), (6, "é日本 " * 30)]
    found = runs.periodic_runs(docs_of(rows, runs="1", n_words="'x'", collapsed_text="2"))
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in found.collect()), key=str)
    expected = [(i, 0, [], "") for i in (1, 2, 3)]
    expected += [(4, 300_001, [(0, 300_000, 1)], "x " + "y" * 3_000_000), (6, 30, [(0, 30, 1)], "é日本")]
    expected += [(i, 40, [(0, 40, 1)], "a") for i in (None, 5, 5)]
    assert got == sorted(expected, key=str)
    assert runs.periodic_runs(docs_of([])).count() == 0


def test_the_most_repeated_run_is_the_first_of_equal_ones(spark):
    table = spark.sql(
        "SELECT array(named_struct('start', 0L, 'length', 30L, 'period', 10L), named_struct('start', 40L, 'length', 60L, 'period', 2L), "
        "named_struct('start', 200L, 'length', 90L, 'period', 3L)) AS runs UNION ALL SELECT array()"
    )
    got = [r[0] for r in table.select(runs.most_repeated(F.col("runs"))).collect()]
    assert [None if r is None else r["start"] for r in got] == [40, None]


def test_op11_equals_the_contract_in_plain_python(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 3000]
    planted = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        elif len(set(words)) == n:
            continue
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        row = got[doc_id]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
    assert planted > 20 and len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


# --- token counts ------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def counter():
    return tokencounts.PrefixCounter(queries.piece_model(), cached=2_000)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  ▁▁\n\t'eethinorsl<s>0x0\0é日本")), max_size=40))
def test_every_prefix_has_the_count_of_its_own_encoding(pieces, counter, text):
    assert counter.prefixes(text).tolist() == [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]
    assert counter.total(text) == len(pieces.encode(text))


def test_counts_of_whole_documents(spark, pieces):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_token_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n = len(pieces.encode(text or ""))
        assert tuple(got[doc_id]) == (doc_id, len((text or "").encode()), n, n > 4096)


def test_questions_are_read_off_stored_counts(spark, docs_of, pieces):
    text = "Les gens naïfs — über 日本 🙂 <s> the the\nend " * 5
    table = tokencounts.token_counts(docs_of([(1, text), (2, None), (3, "")]), queries.piece_model(), prefixes=True)
    budget = 40
    asked = table.select(
        "doc_id", "n_tokens", "prefix_tokens", "lang",
        tokencounts.tokens_before(17).alias("before"), tokencounts.longest_within(budget).alias("longest"), tokencounts.truncated(budget).alias("cut"),
    ).collect()
    rows = {r["doc_id"]: r for r in asked}
    plain = [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]
    assert rows[1]["prefix_tokens"] == plain and rows[1]["n_tokens"] == plain[-1] and rows[1]["before"] == plain[17]
    longest = max(i for i, n in enumerate(plain) if n <= budget)
    assert rows[1]["longest"] == longest and rows[1]["cut"] == text[:longest]
    for i in (2, 3):
        assert (rows[i]["n_tokens"], rows[i]["prefix_tokens"], rows[i]["before"], rows[i]["longest"]) == (0, [0], 0, 0)


def test_counts_of_odd_rows(docs_of, pieces):
    rows = [(1, None), (2, ""), (3, LONG), (None, "a b"), (4, "twin"), (4, "twin")]
    got = tokencounts.token_counts(docs_of(rows, n="1"), queries.piece_model()).select("doc_id", "n", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, 1, len(pieces.encode(t or ""))) for i, t in rows], key=str)
    assert tokencounts.token_counts(docs_of([]), queries.piece_model()).count() == 0
    with pytest.raises(ValueError):
        tokencounts.token_counts(docs_of([], n_tokens="1"), queries.piece_model())


# --- tries -------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def plain_nodes(conversations):
    """The contract's nodes of {conv_id: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, ids in members.items():
        own = (len(ids) - 1) * len(prefix[-1][1].split()) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += kids[prefix] == 0
            saved[prefix[:d]] += own
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(ids), len(p), min(members[p[:-1]]) if p else -1, len(ids), kids[p], leaves[p], saved[p], digest(ends[p]))
        for p, ids in members.items()
    )


def trie_nodes(spark, conversations, **options):
    rows = [(c, i, *turn) for c, turns in conversations.items() for i, turn in enumerate(turns)]
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    members = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    found = tries.prefix_trie(tries.turn_digests(table), ["position"], members, **options)
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


@pytest.mark.parametrize("options", [{}, {"shard_turns": 4}, {"segment": 2}, {"shard_turns": 3, "segment": 3}, {"shard_turns": 1, "segment": 4}])
def test_trie_equals_the_plain_one(spark, options):
    rng = random.Random(5)
    conversations = {c: [(rng.choice("ua"), rng.choice(["x", "y z", ""])) for _ in range(rng.choice([0, 1, 2, 5, 9, 14]))] for c in range(40)}
    conversations |= {c: conversations[7] for c in range(100, 130)} | {2**60 + c: conversations[3] for c in range(3)} | {-5: [("u", "x")], -4: []}
    hot = [("u", "hello there")] * 6
    conversations |= {c: hot + [("a", str(c % 9))] * (c % 5) for c in range(200, 240)}
    assert trie_nodes(spark, conversations, **options) == plain_nodes(conversations)


def test_a_long_conversation_and_its_copy(spark):
    turns = [("u", str(i % 7)) for i in range(700)]
    conversations = {1: turns, 2: turns, 3: turns[:650] + [("a", "other")]}
    assert trie_nodes(spark, conversations, segment=256, shard_turns=100) == plain_nodes(conversations)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 0, "u", "a b"), (1, 0, "u", "a b"), (None, 1, "u", "lost"), (2, 5, None, None)]
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS words", "'p' AS position", "2 AS segment")
    got = tries.prefix_trie(tries.turn_digests(table), ["position"]).collect()
    expected = plain_nodes({1: [("", "")] * 2 + [("u", "a b")] * 2, 2: [("", "")]})
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == expected
    assert tries.prefix_trie(tries.turn_digests(table.where("false")), ["position"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=8), min_size=1, max_size=60))
def test_double_array_holds_each_sequence_once(sequences):
    trie, states = tries.DoubleArray(4), {(): 0}
    for d in range(1, 9):
        pairs = sorted({(states[tuple(s[: d - 1])], s[d - 1]) for s in sequences if len(s) >= d})
        if pairs:
            old, new = (np.array(x) for x in zip(*pairs, strict=True))
            trie.add(old, new)
        for s in sequences:
            if len(s) >= d:
                states[tuple(s[:d])] = int(trie.step(np.array([states[tuple(s[: d - 1])]]), np.array([s[d - 1]]))[0])
    assert len(set(states.values())) == len(states) == (trie.check >= 0).sum()
    with pytest.raises(KeyError):
        trie.step(np.array([0]), np.array([len(trie.check) - 1 - trie.base[0]]))


def test_op13_equals_its_sql(spark):
    assert difference(connect(SF), queries.QUERIES["op13_prefix_trie"](spark, SF), queries.ORACLE_SQL["op13_prefix_trie"]) is None
