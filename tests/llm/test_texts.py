"""Packing, sharding, leaks, language, quality, toxicity and the language model."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlens.llm import classlm, decontaminate, langid, packing, quality, sharding, toxicity
from ticketlens.llm.queries import tokenizer_files

from .brute import LOWER, smith_waterman, words

ODD = [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "1234 ?!"), (None, "no id"), (9004, "twin"), (9004, "twin"), (9004, "other"), (9005, "x" * 3_000_000), (9006, "é日本🙂 ")]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(**tokenizer_files())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t\x1c\x85'sl<|endoftext|>")), max_size=60))
def test_ids_equal_the_tokenizers(encoder, text):
    assert encoder.ids(text.encode()).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


def test_ids_of_every_character_and_added_token(encoder):
    for lo in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)} {chr(c)}b" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000)
        assert encoder.ids(text.encode()).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids, hex(lo)
    assert 50256 in encoder.ids(b"a <|endoftext|> b").tolist()


def test_packing_round_trip(docs_of, encoder):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "zqx", "\n", "é"]) for _ in range(rng.choice([1, 50, 700, 3000])))) for i in range(80)]
    rows += [r for r in ODD if r[0] != 9005] + [(9007, "word " * 30_000)]
    cut = packing.pieces(docs_of(rows, start="'x'", sequence_id="1"), **tokenizer_files(), length=512, keep_ids=True)
    packed = packing.pack(cut, length=512, group_pieces=100)
    pieces = packed.collect()
    texts = sorted(struct.pack("<%dI" % (len(ids) + 1), *ids, 1) for ids in (encoder.exact.encode(t or "", add_special_tokens=False).ids for _, t in rows))
    whole: dict = {}
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(p["ids"])
        whole.setdefault(p["doc_id"], []).append(p)
    unique = [i for i, n in Counter(i for i, _ in rows).items() if n == 1]
    for i in unique:
        parts = sorted(whole[i], key=lambda p: p["start"])
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert b"".join(p["ids"] for p in parts) in texts and parts[0]["doc_tokens"] == sum(p["length"] for p in parts)
    assert sum(p["length"] for p in pieces) * 4 == sum(map(len, texts))
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert sum(p["length"] for p in parts) <= 512
    built = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert {k: b"".join(p["ids"] for p in v) for k, v in by_sequence.items()} == {k: bytes(r["ids"]) for k, r in built.items()}
    assert packing.pack(packing.pieces(docs_of([]), **tokenizer_files())).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing_equals_the_plain_scan(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
    free: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
        free += [64] * (at == len(free))
        assert (bins[i], offsets[i]) == (at, 64 - free[at])
        free[at] -= lengths[i]


def _check_shards(rows, found, shards):
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sizes
    for s in range(shards):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    return Counter(r["shard"] for r in found)


def test_shards_are_even_and_little_moves(docs_of):
    rows = [(i, f"text {i}") for i in range(3000)] + [(7, "hot")] * 1500 + [(None, f"n{i}") for i in range(40)] + ODD
    found = sharding.shard(docs_of(rows, shard="'x'", point="1"), shards=16, cell_rows=64).collect()
    counts = _check_shards(rows, found, 16)
    assert max(counts.values()) - min(counts.values()) <= 1
    ring = sharding.Ring.of(16, 256)
    own = Counter(r["home_shard"] for r in found)
    over = sum(max(0, n - -(-len(rows) // 16)) for n in own.values())
    assert sum(r["shard"] != r["home_shard"] for r in found) <= over + 16 and len(ring.places) == 4096


def test_slack_leaves_more_at_home(docs_of):
    rows = [(i, "t") for i in range(4000)]
    moved = []
    for slack in (0.0, 0.05, 0.5):
        found = sharding.shard(docs_of(rows), shards=8, virtual_nodes=64, slack=slack).collect()
        counts = _check_shards(rows, found, 8)
        assert max(counts.values()) <= math.ceil(500 * (1 + slack))
        moved.append(sum(r["shard"] != r["home_shard"] for r in found))
    assert moved[0] > moved[1] > moved[2] == 0
    assert sharding.shard(docs_of([])).count() == 0


def test_ring_intervals_cover_the_ring_once():
    ring = sharding.Ring.of(5, 9)
    parts = sorted((low, high, point) for _, low, high, point in ring.intervals())
    assert parts[0][0] == 0 and parts[-1][1] == 2**62 - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:], strict=False))
    for low, high, point in parts:
        assert point == next((i for i, p in enumerate(ring.places) if p >= high), 0)


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"B{rng.randrange(900)}," if rng.random() < 0.2 else f"of the b{rng.randrange(900)}" for _ in range(rng.randrange(10, 25)))) for i in range(20)]
    return items, spark.createDataFrame(items + [(None, "x y z"), (50, None), (51, ""), (52, "two words")], "item_id long, text string")


def test_leaks_of_copies_and_edits(docs_of, benchmark):
    items, table = benchmark
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice(["of the", "and", f"n{rng.randrange(5000)}"]) for _ in range(n))
    rows, expected = [], set()
    for i in range(60):
        item_id, text = items[i % 20]
        kept = text.split()
        if i >= 20:  # every seventh word changed, left out or added to
            at = range(rng.randrange(7), len(kept), 7)
            kept = [w for j, w in enumerate(kept) for w in ([w] if j not in at else [["new"], [], [w, "more"]][j % 3])]
        body = " ".join(kept)
        rows.append((i, f"{noise(80)} {body.upper() if i % 4 == 0 else body} {noise(50)}"))
        expected.add((i, item_id))
    rows += [(100 + i, noise(400)) for i in range(60)] + ODD
    found = decontaminate.leaks(docs_of(rows, item_id="'x'", score="1"), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == 60
    df = Counter(w for _, t in rows for w in set(re.sub(r"[\W_]+", " ", (t or "").lower()).split()))
    common = {w for w, n in df.items() if n > 0.05 * len(rows)}
    assert {"of", "the"} <= common
    for r in found:
        passage, item = ([w.lower().strip(",") for w in words(t)] for t in (dict(rows)[r["doc_id"]], dict(items)[r["item_id"]]))
        whole = smith_waterman(passage, item, common)
        assert r["score"] == pytest.approx(whole / sum(1 if w in common else 2 for w in item))
        assert smith_waterman(passage[r["start"] : r["end"]], item, common) == whole
    kept = decontaminate.without_leaks(docs_of(rows, row="1"), table)
    assert kept.columns[-1] == "row" and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted((i or 0) for i, _ in rows if (i or 0) >= 60 or i is None)
    small = decontaminate.LeakRule(block_words=100)  # several blocks of items
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(rows), table, small).collect()} == expected


def test_an_item_in_most_documents_is_still_found(docs_of, benchmark):
    items, table = benchmark
    rows = [(i, f"start{i} {items[3][1]} end{i}") for i in range(90)] + [(100 + i, f"of the and of the q{i}") for i in range(30)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(rows), table).collect()) == [(i, 3) for i in range(90)]
    assert decontaminate.leaks(docs_of([]), table).count() == 0
    assert decontaminate.leaks(docs_of(rows), table.where("false")).count() == 0
    assert decontaminate.without_leaks(docs_of(rows), table.where("false")).count() == len(rows)


@pytest.mark.parametrize("holders", [6, 100, 200])
def test_one_edited_version_in_many_documents(spark, docs_of, holders):
    """Of 600 documents; a rarer version of each item may stand in a few more, and everyday words in all."""
    rng = random.Random(5)
    items, rows, expected = [], [], set()
    noise = lambda n: " ".join(rng.choice(["of", "the", "and", f"n{rng.randrange(5000)}"]) for _ in range(n))
    for item, changes in enumerate((3, 4, 6)):
        text = [f"i{item}w{j}" if j % 5 else "the" for j in range(30)]
        items.append((item, " ".join(text)))
        at = {(2 * c + 1) * 30 // (2 * changes) for c in range(changes)}
        often = " ".join(f"other{item}x{j}" if j in at else w for j, w in enumerate(text))
        rarely = " ".join(f"rare{item}x{j}" if j in (2, 28) else w for j, w in enumerate(text))
        for k in range(holders + holders // 50):
            rows.append((1000 * item + k, f"{noise(20)} {often if k < holders else rarely} {noise(20)}"))
            expected.add((1000 * item + k, item))
    rows += [(10_000 + k, noise(60)) for k in range(600 - len(rows))]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(docs_of(rows), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == len(expected)
    # 24 words at 2 and 6 at 1, less those changed and 1 for each change
    assert min(r["score"] for r in found) >= (54 - 3 * 6) / 54
    assert decontaminate.without_leaks(docs_of(rows), table).count() == len(rows) - len(expected)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=5), st.lists(st.integers(1, 4), min_size=1, max_size=8))
def test_alignment_equals_plain_smith_waterman(passages, item):
    scores = np.array([1 if w == 1 else 2 for w in item])
    score, _ = decontaminate.align([np.array(p, np.uint64) for p in passages], np.array(item, np.uint64), scores, decontaminate.LeakRule())
    assert score.tolist() == [smith_waterman(p, item, {1}) for p in passages]


LANGS = {"en": ["the", "and", "ing", "tion", "th", "wh"], "de": ["der", "und", "sch", "ung", "ä", "keit"], "fr": ["le", "et", "eau", "é", "ment", "que"]}


def _talk(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n))


def test_language_of_known_and_unseen_words(spark, docs_of):
    rng = random.Random(1)
    truth = {i: rng.choice(list(LANGS)) for i in range(300)}
    rows = [(i, _talk(rng, lang, rng.choice([3, 30, 300]))) for i, lang in truth.items()]
    examples = spark.createDataFrame([(t, truth[i]) for i, t in rows[:150]] + [(None, "en"), ("x", None)], "text string, lang string")
    model = langid.fit_languages(examples, per_language=40)
    found = {r["doc_id"]: r for r in langid.predict_languages(docs_of(rows + ODD, lang_pred="1"), model).collect()}
    assert sum(found[i]["lang_pred"] == truth[i] for i in range(150, 300)) >= 147
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (9000, 9001, 9002, 9003)] == ["und"] * 4 and found[9006]["lang_pred"] in LANGS
    unseen = langid.predict_languages(docs_of([(1, "schäungkeitungsch"), (2, "eaumentéque")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in unseen} == {1: "de", 2: "fr"}
    kept = langid.identified(docs_of(rows + ODD, score="'clash'"), model)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns[-1] == "score" and not ids & {9000, 9001, 9002, 9003}
    assert ids >= {i for i, r in found.items() if r["score"] >= 0.5} and len(ids & set(truth)) >= 297


def test_language_without_examples(docs_of, spark):
    model = langid.fit_languages(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict_languages(docs_of([(1, "a"), (2, None)]), model).collect()} == {"und"}
    assert [r["doc_id"] for r in langid.identified(docs_of([(1, "a"), (2, None), (3, "?")]), model).collect()] == [1]
    assert langid.predict_languages(docs_of([]), model).count() == 0


def _labelled(spark, labels):
    return spark.createDataFrame(labels + [(None, 1), (5000, None), (5001, 7)], "doc_id long, label int")


def test_quality_tells_junk_from_prose(spark, docs_of):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(400):
        good = rng.random() < 0.8
        text = _talk(rng, rng.choice(list(LANGS)), 60)
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join([text.split()[0]] * 60)])
        rows.append((i, text))
        truth[i] = int(good)
    labels = [(i, truth[i]) for i in range(250)] + [(3, truth[3])]
    model = quality.fit_quality(docs_of(rows), _labelled(spark, labels), quality.Features(bits=14))
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(docs_of(rows + ODD, score="1", label="2"), model).collect()}
    assert sum((found[i] >= 0.3) == truth[i] for i in range(250, 400)) >= 142
    assert all(0 <= s <= 1 for s in found.values()) and found[9001] == found[9000] == found[9002]
    again = quality.fit_quality(docs_of(rows), _labelled(spark, labels), quality.Features(bits=14))
    assert (again.weight == model.weight).all()
    for few in ([], [(1, 1), (2, 1)]):
        constant = quality.fit_quality(docs_of(rows), _labelled(spark, few))
        assert len({r["score"] for r in quality.score_quality(docs_of(rows[:5]), constant).collect()}) == 1
    assert quality.score_quality(docs_of([]), model).count() == 0


def _toxic_rows(n=500):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(n):
        text = _talk(rng, "en", rng.choice([5, 40, 200])).split()
        truth[i] = int(rng.random() < 0.2)
        if truth[i]:
            for w in rng.sample(["idiot", "moron", "trash", "Stupid!"], 2):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
    return rows, truth


def test_toxicity_by_neighbours(spark, docs_of):
    rows, truth = _toxic_rows()
    model = toxicity.fit_toxicity(docs_of(rows), _labelled(spark, [(i, truth[i]) for i in range(300)]))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs_of(rows + ODD, evidence="1"), model).collect()}
    assert sum((found[i]["score"] >= 0.7) == truth[i] for i in range(300, 500)) >= 192
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[9000]["score"] == found[9001]["score"] < 0.5
    assert all(truth[found[i]["evidence"][0]] for i in range(300, 500) if found[i]["score"] >= 0.7)
    for few in ([], [(1, 0)]):
        constant = toxicity.fit_toxicity(docs_of(rows), _labelled(spark, few))
        assert len({r["score"] for r in toxicity.score_toxicity(docs_of(rows[:4]), constant).collect()}) == 1
    assert toxicity.score_toxicity(docs_of([]), model).count() == 0


def _tfidf(texts, prefixes=(4,)):
    """Counts of a text's words and of beginnings of longer words."""
    counts = []
    for t in texts:
        ws = re.sub(r"[\W\d_]+", " ", (t or "").lower()).split()
        counts.append(Counter([*ws, *((n, w[:n]) for w in ws for n in prefixes if len(w) > n)]))
    return counts


@pytest.mark.parametrize("options", [{}, {"block": 8, "k": 5, "common_share": 0.1}, {"block": 16, "common_share": 0.0}, {"common_share": 2.0}])
def test_neighbours_are_those_of_the_tfidf_cosine_of_the_texts(spark, docs_of, options):
    """From the texts by plain counting, at default settings too: all terms, real counts, no label."""
    rng = random.Random(12)
    topics = [[f"{chr(97 + t)}{chr(97 + j)}topic" for j in range(12)] for t in range(20)]  # at most 38 words: one passage
    every = "the of and to in is it was for on".split()
    rows = [(i, " ".join(rng.choices(topics[i % 20], k=8) + rng.choices(every, k=rng.randrange(1, 30)))) for i in range(260)]
    truth = {i: int(i % 20 < 7) for i in range(240)}
    model = toxicity.fit_toxicity(docs_of(rows), _labelled(spark, list(truth.items())), **options)
    counts = _tfidf([t for _, t in rows])
    df = Counter(w for c in counts[:240] for w in c)
    idf = {w: math.log(241 / (1 + n)) + 1 for w, n in df.items()}
    vectors = [{w: (1 + math.log(n)) * idf[w] for w, n in c.items() if w in idf} for c in counts]
    vectors = [{w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in vectors]
    found = {r["doc_id"]: r["neighbours"] for r in toxicity.score_toxicity(docs_of(rows), model).collect()}
    assert sorted(model.examples.ids.tolist()) == list(range(240)) and model.examples.k == options.get("k", 15)
    for i, v in enumerate(vectors):
        cosine = [sum(x * vectors[e].get(w, 0.0) for w, x in v.items()) for e in range(240)]
        kth = sorted(cosine)[-model.examples.k]
        assert len(found[i]) == model.examples.k == len(set(found[i])) and all(cosine[e] >= kth - 1e-9 for e in found[i])
        near = [cosine[e] for e in found[i]]
        assert all(x >= y - 1e-9 for x, y in zip(near, near[1:]))


def test_passages_are_added_up_one_by_one(spark, docs_of, monkeypatch):
    """What is added up at once has the length of the index, however many passages are searched together."""
    rng, lengths = random.Random(13), []
    rows = [(i, " ".join(f"{'ab'[i % 2]}{chr(97 + rng.randrange(26))}term" for _ in range(120))) for i in range(80)]
    index = toxicity.fit_toxicity(docs_of(rows), _labelled(spark, [(i, i % 2) for i in range(80)]), passage=20, common_share=0.9).examples
    add = np.bincount
    monkeypatch.setattr(toxicity.np, "bincount", lambda x, weights=None, minlength=0: (lengths.append(minlength), add(x, weights, minlength))[1])
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows[:20]]})
    assert len(list(toxicity._searched(index, batch))) == 20
    assert max(lengths) <= max(index.width, 20 * 6)


def _told_one_by_one(index, texts):
    """(vote, neighbours) of each text: every passage by itself, with all its neighbours in double precision."""
    from ticketlens.llm.words import split

    words_ = split(texts, 0, len(texts))
    passage, text = toxicity.passages(words_, index.passage)
    owner, term, weight = index.vectors(words_, passage, len(text))
    best = {}
    for p, t in enumerate(text.tolist()):
        of = owner == p
        which, hit, _, sums = index.candidates(owner[of] - p, term[of], weight[of], 1)
        which, hit, cosine = index.nearest(which, hit, sums)
        vote = float(index.votes(which, hit, cosine, 1)[0])
        if len(hit) and (t not in best or vote > best[t][0]):
            best[t] = vote, hit.tolist()
    return best


@pytest.mark.parametrize("share,room", [(0.5, 32 << 20), (0.1, 32 << 20), (0.1, 3 * 4 * 320), (2.0, 32 << 20)])
def test_few_passages_are_told_exactly_and_no_result_changes(spark, docs_of, monkeypatch, share, room):
    monkeypatch.setattr(toxicity, "ROW_SHARE", share)
    monkeypatch.setattr(toxicity, "ROW_BYTES", room)
    monkeypatch.setattr(toxicity, "TOGETHER", 7)  # texts go on in the next batch
    rows, truth = _toxic_rows(300)
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # equal examples: which of them are the nearest is told by their order
    labelled = _labelled(spark, [(i, truth[i % 300]) for i in range(340)])
    index = toxicity.fit_toxicity(docs_of(rows), labelled, passage=12).examples
    texts = [toxicity._clean(t.encode()) for _, t in rows[:120]] + [None, b"", b"zzz"]
    expected, told, asked = _told_one_by_one(index, texts), [], type(index).nearest
    monkeypatch.setattr(type(index), "nearest", lambda self, which, *rest: (told.append(len(set(which.tolist()))), asked(self, which, *rest))[1])
    found = {t: (vote, at.tolist()) for t, vote, at in toxicity._searched(index, pa.RecordBatch.from_pydict({"text": texts}))}
    assert found.keys() == expected.keys() and all(found[t][1] == at and abs(found[t][0] - vote) < 1e-9 for t, (vote, at) in expected.items())
    assert sum(told) < 0.7 * sum(-(-len(t.split()) // 12) for t in texts if t)
    assert index.rows.nbytes <= room and (share < 1 or not len(index.rows))


def test_all_words_are_in_passages():
    from ticketlens.llm.words import split

    words_ = split([b"a b c d e", None, b"", b"f", b"g h i j"], 0, 5)
    passage, text = toxicity.passages(words_, 2)
    assert passage.tolist() == [0, 0, 1, 1, 2, 3, 4, 4, 5, 5] and text.tolist() == [0, 0, 0, 3, 4, 4]


def test_few_words_of_a_very_long_text_are_found(spark, docs_of):
    rows, truth = _toxic_rows()
    model = toxicity.fit_toxicity(docs_of(rows), _labelled(spark, [(i, truth[i]) for i in range(300)]))
    calm = " ".join(t for i, t in rows if not truth[i])
    long = [(1, calm), (2, calm[:60_000] + " you idiot moron stupid trash idiot moron trash stupid " + calm[60_000:])]
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of(long), model).collect()}
    assert found[1] < found[2]


def test_repeated_labelled_rows_teach_once(spark, docs_of):
    rows, truth = _toxic_rows(100)
    labelled = _labelled(spark, list(truth.items()))
    once = toxicity.fit_toxicity(docs_of(rows), labelled).examples
    often = toxicity.fit_toxicity(docs_of(rows + [rows[0]] * 300 + [(1, "another text of an id")] * 50), labelled).examples
    assert sorted(once.ids.tolist()) == sorted(often.ids.tolist()) == list(range(100))


def _plain_base(rows, train):
    tokens = {k: [*words((t or "").translate(LOWER)), None] for k, (_, t) in enumerate(rows)}
    counts = Counter(w for k in train for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    return {k: (len(ts), sum(counts[w] > 0 for w in ts), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)) for k, ts in tokens.items()}, n


SMALL = classlm.LmRule(sample_docs=40, head=60, units=20, endings=16, classes=6)


def test_language_model_counts_and_beats_single_words(docs_of):
    rng = random.Random(7)
    rows = [(i, _talk(rng, rng.choice(list(LANGS)), rng.choice([5, 80, 300]))) for i in range(150)]
    rows += [*ODD, (300, "Same text Zwei"), (300, "Same text Zwei"), (301, "neverseen\x1cword")]
    train = [k for k in range(len(rows)) if k % 5 != 1]
    expected, n = _plain_base(rows, train)
    model = classlm.fit_classes(docs_of([rows[k] for k in train]), SMALL)
    found = classlm.score_texts(docs_of(rows, n="1", word="2"), model).collect()
    assert model.train_tokens == n and len(found) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"]) for r in found), key=key)
    assert mine == sorted(((rows[k][0], e[0], e[1]) for k, e in expected.items()), key=key)
    base = sorted((r["base_score"] for r in found))
    assert np.allclose(base, sorted(e[2] for e in expected.values()))
    held = {rows[k][0] for k in range(150) if k % 5 == 1}
    assert sum(r["score"] for r in found if r["doc_id"] in held) > 0.93 * sum(r["base_score"] for r in found if r["doc_id"] in held)


def test_word_probabilities_sum_to_one(docs_of):
    """All known words, the end, and one unseen word of each ending, after a given text."""
    rng = random.Random(11)
    rows = [(i, _talk(rng, "de", 12)) for i in range(30)]
    model = classlm.fit_classes(docs_of(rows), SMALL)
    known = sorted({w for _, t in rows for w in words(t)})
    t, c = model.tables, SMALL.classes
    probe = [(k, w) for k, w in enumerate(known)] + [(10_000, "")]
    endings = {}
    for k in range(200_000):  # an unseen word of each ending
        w = f"q{k}"
        endings.setdefault(int(classlm.endings_of(classlm_words([w]), SMALL)[0]), w)
        if len(endings) == SMALL.endings:
            break
    probe += [(20_000 + e, w) for e, w in endings.items()]
    found = {r["doc_id"]: r["score"] for r in classlm.score_texts(docs_of(probe), model).collect()}
    end = t.unit_class[SMALL.end]
    total = 0.0
    for k, w in probe:
        if k == 10_000:
            total += 10 ** found[k]
            continue
        unit = int(t.words.units_of(classlm_words([w]), SMALL)[2][0])
        of = t.unit_class[unit]
        stop = t.transition[(end * c + of) * c + end] + t.unit_score[SMALL.end]
        total += 10 ** (found[k] - stop)  # without the end that follows the word
    assert total == pytest.approx(1, abs=1e-6)


def classlm_words(some):
    from ticketlens.llm.words import split

    return split([w.encode() for w in some], 0, len(some), lower=True)


@pytest.mark.parametrize("sample", [0, 3, 1000])
def test_units_are_the_most_frequent_words_of_all_documents(docs_of, sample):
    rng = random.Random(8)
    rows = [(i, " ".join([f"only{i % 9}"] * 7 + [f"w{rng.randrange(300)}" for _ in range(30)])) for i in range(90)]
    n = Counter(w for _, t in rows for w in t.split())
    model = classlm.fit_classes(docs_of(rows), classlm.LmRule(sample_docs=sample, head=60, units=9, endings=16, classes=4))
    number, known, unit = model.tables.words.units_of(classlm_words([w for w, _ in n.most_common(9)]), model.rule)
    assert known.all() and sorted(unit.tolist()) == list(range(9))
    assert model.tables.words.own == 9 and model.train_tokens == sum(n.values()) + len(rows)
    scored = classlm.score_texts(docs_of(rows), model).collect()
    assert all(r["n_known"] == r["n_tokens"] == 38 for r in scored)


def test_few_endings_share_a_unit():
    letters = "abcdefghijklmnopqrstuvwxyz"
    endings = classlm.endings_of(classlm_words([f"w{a}{b}{c}" for a in "aeiou" for b in letters for c in letters]), classlm.LmRule())
    assert len(set(endings.tolist())) > 0.95 * len(endings)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    hidden = rng.integers(0, 4, 60)
    pairs = rng.poisson(0.2 + 6 * ((hidden[:, None] + 1) % 4 == hidden[None, :])).astype(float)

    def likelihood(of):
        table = np.zeros((4, 4))
        np.add.at(table, (of[:, None], of[None, :]), pairs)
        g = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
        return g(table) - g(table.sum(0)) - g(table.sum(1))

    found = classlm.exchange(pairs, 4, 20)
    assert likelihood(found) >= likelihood(hidden) - 1e-6


def test_language_model_of_nothing(docs_of):
    model = classlm.fit_classes(docs_of([]), SMALL)
    (row,) = classlm.score_texts(docs_of([(1, "a b")]), model).collect()
    assert (row["n_tokens"], row["n_known"]) == (3, 0) and row["score"] < 0 and math.isfinite(row["base_score"])
    assert classlm.score_texts(docs_of([]), model).count() == 0


def test_toxicity_without_any_telling_term(spark, docs_of):
    model = toxicity.fit_toxicity(docs_of([(1, "a b"), (2, "c d")]), _labelled(spark, [(1, 1), (2, 0)]))
    assert {r["score"] for r in toxicity.score_toxicity(docs_of([(1, "a b"), (3, "q")]), model).collect()} == {model.examples.empty_score}


def test_toxicity_of_texts_with_common_terms_only(spark, docs_of):
    """No passage of a batch has a term of few examples, or the examples have no common term at all."""
    labelled = _labelled(spark, [(i, i % 2) for i in range(8)])
    same = toxicity.fit_toxicity(docs_of([(i, "aa bb" if i % 2 else "aa cc") for i in range(8)]), labelled, common_share=0.1)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of([(1, "aa bb"), (2, "aa cc")]), same).collect()}
    assert scores[1] > 0.5 > scores[2]
    apart = toxicity.fit_toxicity(docs_of([(i, chr(97 + i) * 3) for i in range(8)]), labelled)
    (row,) = toxicity.score_toxicity(docs_of([(1, "bbb")]), apart).collect()
    assert row["neighbours"] == [1]
