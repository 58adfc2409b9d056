"""The pipeline against plain Python, stage by stage, and the registered queries."""

import importlib.util
import random
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ticketlens.llm import packing
from ticketlens.llm.queries import tokenizer_files
from tests.oracle_check import connect, difference

from .brute import near_groups, without_repeats
from .conftest import SCHEMA

SF = "/root/testdata/sf0.01"
SYLLABLES = {"en": ["the", "and", "ing", "tion", "wh", "er", "st", "ou"], "de": ["der", "und", "sch", "ung", "ä", "keit", "ver", "ß"]}


def _word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.choice([1, 2, 3, 4])))


def _prose(rng, lang, n):
    return " ".join(_word(rng, lang) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(i, _prose(rng, rng.choice(["en", "de"]), 30)) for i in range(10)]
    shared = _prose(rng, "en", 70)
    rows = []
    for i in range(200):
        lang = rng.choice(["en", "de"])
        text = _prose(rng, lang, rng.choice([40, 90, 400]))
        if i % 9 == 0:
            text = f"{text}\n{shared}\n{_prose(rng, lang, 20)}"
        if i % 13 == 0:
            text = f"{text} {items[i % 10][1]} {_prose(rng, lang, 60)}"
        rows.append((i, text, lang))
    for i in range(200, 260):  # copies, some with a word changed
        _, text, lang = rows[rng.randrange(0, 40)]
        changed = text.split(" ")
        if i % 2:
            changed[rng.randrange(len(changed))] = "changed"
        rows.append((i, " ".join(changed), lang))
    rows += [(300, None, "en"), (301, "", "en"), (302, "123 ...", None), (None, _prose(rng, "en", 50), "en"), (5, rows[5][1], "en")]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("corpus")
    table = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA).selectExpr("*", "1 AS node", "2 AS kept_text")
    table.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def _expected(rows, items):
    """(doc_id, text) of what all stages but the last leave."""
    kept = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    groups = near_groups([(i, t) for i, t in kept if i is not None], 5)
    one = {i: t for i, t in kept if i is not None and groups[i][1] == i}
    kept = [*one.items(), *[(i, t) for i, t in kept if i is None]]
    cleaned = without_repeats(kept, 35)
    kept = [(i, left if gone else t) for (i, t), (_, _, gone, left) in zip(kept, cleaned, strict=True)]
    return [(i, t) for i, t in kept if not any(" ".join(text.split()) in " ".join(t.split()) for _, text in items)]


def test_pipeline_equals_plain_python(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == columns, name
        docs = corpus_pipeline.settle(docs, name)
    expected = _expected(rows, items)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, docs.select("doc_id", "text").collect()), key=key) == sorted(expected, key=key)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert 60 < len(expected) < 200
    encoder = packing.Encoder(**tokenizer_files())
    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = {i: len(encoder.exact.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected}
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == whole
    assert sum(p["length"] for p in pieces) == sum(whole.values())


def test_different_texts_of_one_id_all_stay(spark, docs_of):
    rng = random.Random(3)
    a, b, c, d = (_prose(rng, "en", 80) for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (7, a), (8, c), (4, c), (9, f"{b} more"), (None, d), (None, d), (6, d)]
    got = corpus_pipeline.drop_near_duplicates(spark, docs_of(rows, extra="1"), "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, a), (5, b), (4, c), (None, d), (None, d), (6, d)], key=str)
    assert got.columns[-1] == "extra"
    once = corpus_pipeline.drop_near_duplicates(spark, docs_of([r for r in rows if r[0] != 5]), "")
    assert sorted(r["doc_id"] or 0 for r in once.collect()) == [0, 0, 4, 6, 7, 9]


def test_every_document_with_a_letter_has_a_language(spark):
    rng = random.Random(4)
    known = [(i, _prose(rng, "en" if i % 2 else "de", 40), lang) for i, lang in enumerate(["en", "de", "fr", "es", "it", "pt", "nl", "sv"] * 8)]
    rows = known + [(100, "Это предложение написано по-русски.", None), (101, "这是一个用中文写的句子。", None), (102, "ok", None), (103, "1 2 !", None), (104, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == set(range(64)) | {100, 101, 102}


def test_documents_get_the_language_of_their_text(spark):
    rng = random.Random(14)
    known = [(i, _prose(rng, lang, 40), lang) for i, lang in enumerate(["en", "de"] * 30)]
    rows = known + [(100, _prose(rng, "de", 30), None), (101, _prose(rng, "en", 30), "de"), (102, "Это предложение по-русски.", None), (103, "这是一个句子。", "zh?"), (104, "7 !", "en")]
    docs = spark.createDataFrame([(lang, i, text, "kept") for i, text, lang in rows], "lang string, doc_id long, text string, extra string")
    found = corpus_pipeline.identify_language(spark, docs, "")
    assert found.schema == docs.schema
    got = {r["doc_id"]: (r["lang"], r["text"], r["extra"]) for r in found.collect()}
    want = {i: lang for i, _, lang in known} | {100: "de", 101: "en", 102: None, 103: "zh?"}
    assert got == {i: (want[i], text, "kept") for i, text, _ in rows if i in want}


def test_a_very_long_text_goes_through_all_stages(spark, corpus, tmp_path):
    folder, _, _ = corpus
    rng = random.Random(5)
    words = [_word(rng, "en") for _ in range(40_000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    assert len(long) > 3_000_000
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    more = spark.createDataFrame([(9999, long, "en", "s", len(long))], SCHEMA).selectExpr("*", "1 AS node", "2 AS kept_text")
    docs.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 9999").collect()
    assert len({p["doc_tokens"] for p in pieces}) == 1 and sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"] > 400_000


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    folder, _, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


LLM = sorted(name for name in entry.queries() if name.startswith("op") or name == "pipeline")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM if n != "pipeline") == list(range(1, 14))


def _truth(spark, column):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/{column[0]}.parquet").select("doc_id", column[1]).collect()}


def _fold(i, folds):
    return zlib.crc32(str(i).encode()) % folds


@pytest.mark.parametrize(
    "name, column, fold, score, least",
    [("op1_quality", ("labels", "quality"), (5, 0), "predicted", 0.97), ("op10_toxicity", ("labels", "toxic"), (3, 1), "predicted", 0.95), ("op9_language_id", ("documents", "lang"), (4, 2), "lang_pred", 0.99)],
)
def test_held_out_accuracy(spark, name, column, fold, score, least):
    found = entry.queries()[name](spark, SF).collect()
    truth = _truth(spark, column)
    assert all(r["held_out"] == (_fold(r["doc_id"], fold[0]) == fold[1]) for r in found)
    judged = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(judged) > 60 and sum(r[score] == truth[r["doc_id"]] for r in judged) >= least * len(judged)
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == 1000


def test_language_model_beats_single_words_on_held_out_text(spark):
    found = [r for r in entry.queries()["op7_class_model"](spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > 0.95 * sum(r["base_score"] for r in found)


def test_near_duplicate_query_equals_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry.queries()["op8_minmax_near_duplicates"](spark, SF).collect()}
    assert found == near_groups(docs, 4)


def test_leak_query_finds_all_copies_and_no_more(spark):
    docs = {r[0]: r[1].split() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = {r[0]: r[1].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = {i: set(zip(*[w[k:] for k in range(8)], strict=False)) for i, w in items.items()}
    expected = {(d, i) for d, w in docs.items() for own in [set(zip(*[w[k:] for k in range(8)], strict=False))] for i, g in grams.items() if own & g}
    assert {(r["doc_id"], r["item_id"]) for r in entry.queries()["op3_benchmark_leaks"](spark, SF).collect()} == expected


def test_shard_query_is_even(spark):
    found = entry.queries()["op5_shard_ring"](spark, SF).groupBy("shard", "law").count().collect()
    assert {r["law"] for r in found} == {"rows"} and sorted({r["count"] for r in found}) == [62, 63] and len(found) == 16


@pytest.mark.parametrize("name", ["op4_near_vectors", "op6_remove_repeats"])
def test_query_equals_sql(spark, name):
    assert difference(connect(SF), entry.queries()[name](spark, SF), entry.oracle_sql()[name]) is None


def test_the_guard_lets_other_queries_work():
    """Without the subpackage, the entry point registers the rest."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('ticketlens.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'kpis_tickets' in e.queries() and not [n for n in e.queries() if n[:2] == 'op']\n"
    )
    import subprocess
    import sys

    root = importlib.util.find_spec("__spark_entry__").origin.rsplit("/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
