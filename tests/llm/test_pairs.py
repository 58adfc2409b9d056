"""Near-duplicates of texts and of vectors, and repeated passages, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ticketlens.llm import components, minmax, substring, vectors

from .brute import Groups, near_groups, without_repeats


def _sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def _family(rng, n, size, edits):
    base = _sentence(rng, size).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [_sentence(rng, rng.randrange(1, 200)) for _ in range(150)]
    rows += _family(rng, 60, 120, 6) + _family(rng, 30, 60, 3) + [rows[0]] * 40 + [rows[1].upper()] * 3
    rows += ["", None, "  \n", "one", "one", "One two", "a b c", "a b c", "a b c d"]
    rows.append(_sentence(rng, 200_000))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(docs_of, texts, k):
    found = minmax.near_duplicates(docs_of(texts, component_id="'x'", TEXT_="1"), minmax.NearRule(shingle=k)).collect()
    expected = near_groups(texts, k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert len(found) == len(texts) and got == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert sum(i == c for i, (_, c) in expected.items()) < len(texts) - 80


def test_links_that_the_pivot_does_not_make(docs_of):
    """A chain: each text is near the next, the ends are far apart; and no two meet the smallest directly."""
    rng = random.Random(8)
    text, rows = _sentence(rng, 100).split(), []
    for i in range(12):
        rows.append((i, " ".join(text)))
        for j in range(3):
            text[(i * 8 + j * 2) % 100] = f"new{i}.{j}"
    found = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(docs_of(rows), minmax.NearRule(shingle=4)).collect()}
    assert found == {i: c for i, (_, c) in near_groups(rows, 4).items()}


def test_near_duplicates_odd_rows(spark, docs_of):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")]
    found = minmax.near_duplicates(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"]) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    (odd,) = [r for r in found if r["doc_id"] is None]
    assert odd["component_id"] is None and odd["kept"]
    assert minmax.near_duplicates(docs_of([])).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    groups = Groups(range(500))
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {n: groups.find(n) for e in edges if None not in e and e[0] != e[1] for n in e}
    assert {r["node"]: r["component"] for r in found} == expected and len(found) == len(expected)


def _repeats(docs_of, rows, window, **extra):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs_of(rows, **extra), window=window).collect())


def _expected(rows, window):
    return sorted((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in without_repeats(rows, window))


def test_repeated_passages_equal_brute_force(docs_of):
    rng = random.Random(4)
    shared = [_sentence(rng, n) for n in (34, 35, 36, 60, 300)]
    rows = []
    for i in range(120):
        parts = [_sentence(rng, rng.randrange(0, 60)) for _ in range(4)]
        for passage in rng.sample(shared, rng.randrange(3)):
            words = passage.split()
            cut = rng.randrange(0, 12)
            parts.insert(rng.randrange(5), " ".join(words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]))
        rows.append((i, "  ".join(parts)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, "Of " * 400), (203, "a b " * 50), (204, "a b c " * 12 + "d"), (205, None), (206, ""), (207, "x\x1cy z v")]
    rows += [(208, _sentence(rng, 100_000) + " " + shared[4])]
    rows.append((209, " ".join([*shared[3].split()[:50], "edge", *shared[3].split()[10:]])))
    assert _repeats(docs_of, rows, 35, found="1", n_words="'clash'", row_identity="2") == _expected(rows, 35)


def test_repeated_passages_short_windows(docs_of):
    """Windows little longer than the seeds, over few words, so that chance repeats abound."""
    rng = random.Random(5)
    rows = [(i, _sentence(rng, rng.randrange(60), vocabulary=6)) for i in range(60)]
    assert _repeats(docs_of, rows, 9) == _expected(rows, 9)


def test_repeated_passages_equal_rows_and_empty(docs_of):
    text = " ".join(f"t{i}" for i in range(40))
    found = substring.remove_repeats(docs_of([(1, text), (1, text), (2, "q")]), window=35).select("doc_id", "n_removed", "kept_text", "lang").collect()
    assert sorted(map(tuple, found)) == [(1, 40, "", "en"), (1, 40, "", "en"), (2, 0, "q", "en")]
    assert substring.remove_repeats(docs_of([])).count() == 0


def test_regular_words_are_told_apart(docs_of):
    turns = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[t ^ flip] for t in turns) for flip in (0, 1))
    rows = [(1, " ".join([one] * 35)), (2, " ".join([other] * 35))]
    assert [r["n_removed"] for r in substring.remove_repeats(docs_of(rows)).collect()] == [0, 0]


def test_factors_have_their_sources(docs_of):
    """Every factor stands where it says, is as long as that source goes on, and together they are the spans."""
    rng = random.Random(6)
    shared = [_sentence(rng, n).split() for n in (80, 120, 200)]
    rows = []
    for i in range(60):
        words = _sentence(rng, rng.randrange(50)).split()
        for passage in rng.sample(shared, rng.randrange(3)):
            words += passage[rng.randrange(20) : len(passage) - rng.randrange(20)] + _sentence(rng, rng.randrange(3)).split()
        rows.append((i, " ".join(words)))
    rows += [(70, "la " * 300), (71, rows[0][1]), (None, " ".join(shared[0])), (72, " ".join(shared[2][:60] + shared[1][:60]))]
    text_of = {i: t.split() for i, t in rows}
    found = substring.remove_repeats(docs_of(rows)).select("doc_id", "n_removed", "factors", "spans").collect()
    assert sum(len(r["factors"]) for r in found) > 60
    for r in found:
        own, reach = text_of[r["doc_id"]], set()
        for f in r["factors"]:
            source = text_of[f["source_id"]]
            n = f["end"] - f["start"]
            assert n >= 35 and (f["source_id"], f["source_start"]) != (r["doc_id"], f["start"])
            assert own[f["start"] : f["end"]] == source[f["source_start"] : f["source_start"] + n]
            reach.update(range(f["start"], f["end"]))
        assert len(reach) == r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
    (seam,) = [r for r in found if r["doc_id"] == 72]
    assert seam["n_removed"] == 120 and len(seam["factors"]) >= 2 and len(seam["spans"]) == 1


def _linked(rows, threshold):
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            good[i] = (a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()), label)
    groups, links = Groups([r[0] for r in rows]), dict.fromkeys([r[0] for r in rows], 0)
    for a, (va, la) in good.items():
        for b, (vb, lb) in good.items():
            if a < b and la == lb and len(va) == len(vb) and va @ vb >= threshold:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return sorted((i, n, groups.find(i)) for i, n in links.items())


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(60):
            base = rng.standard_normal(48)
            for _ in range(rng.integers(1, 6)):
                rows.append((i := i + 1, [float(x) for x in base + rng.standard_normal(48) * rng.choice([0, 0.05, 0.12, 0.16, 0.2])], label))
    base = rng.standard_normal(48)
    for _ in range(300):  # one large group, over several blocks
        rows.append((i := i + 1, [float(x) for x in base + rng.standard_normal(48) * 0.13], 1))
    same = [float(x) for x in rng.standard_normal(48)]
    rows += [(i := i + 1, same, 0) for _ in range(50)] + [(i := i + 1, [2 * x for x in same], 0), (i := i + 1, same, 1), (i := i + 1, same, None)]
    inf, nan = float("inf"), float("nan")
    for odd in (None, [], [0.0] * 48, [None] + same[1:], [inf] + same[1:], [nan] + same[1:], same[:10], [1e300] * 48, [1e300] * 48, [1e-300] * 48):
        rows.append((i := i + 1, odd, 0))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).selectExpr("*", "1 AS class", "2 AS bucket")
    found = vectors.near_vectors(table, vectors.CosineRule(block=64, task_rows=500)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == _linked(rows, 0.98)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert vectors.near_vectors(table.where("false")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    units = rng.standard_normal((400, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    codes = vectors.Codes.of(units)
    i, j = np.triu_indices(400, 1)
    off = codes.estimate(i, j) - (units[i] * units[j]).sum(1)
    assert abs(off.mean()) < 0.002
    assert (np.abs(off) <= codes.error(6.0)[i]).all() and (np.abs(off) > codes.error(1.0)[i]).mean() > 0.1


def test_bands_lengthen_with_the_vectors_and_miss_no_more():
    rule = vectors.CosineRule()
    for n in (1, 10**3, 10**6, 10**9):
        bits, bands = rule.banding(n)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - agree) ** bands <= rule.miss and 2.0**bits >= min(n, 2**12)


def test_texts_are_shuffled_once(spark, docs_of, tmp_path):
    """The windows and the result read the documents as dealt out by one exchange."""
    rng = random.Random(15)
    passage = _sentence(rng, 60)
    docs_of([(i, f"{_sentence(rng, 50)} a{i} {passage} b{i} {_sentence(rng, 40)}") for i in range(40)], row_identity_wanted="1").write.parquet(str(tmp_path / "docs"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in plain}
    try:
        for name, value in plain.items():
            spark.conf.set(name, value)
        found = substring.remove_repeats(spark.read.parquet(str(tmp_path / "docs")), window=35)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r["n_removed"] for r in found.collect()} == {60}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len([line for line in plan.splitlines() if "Scan parquet" in line and "text#" in line]) == 1
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
