"""The name tagger: decoding against all sequences, and precision and recall on planted names."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketlens.operators import tagger

SEEN = "Kowalski Brandt Okafor Nguyen Silva Haddad Larsen Moreau Petrov Tanaka Weber Rossi".split()
UNSEEN = "Abernathy Zielinski Oyelaran Bergström Castellano Dubois Fitzgerald Yamamoto".split()
OTHER = "Berlin Monday Router Invoice Premium Paris August Firmware".split()
WITH = ["please ask {} about the invoice", "i spoke with {} on the phone", "{} promised me a refund", "a note from {} came in today", "thank {} for the help"]
WITHOUT = ["the parcel went to {} on friday", "my {} is broken since may", "we moved to {} last year", "the {} model is sold out"]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000))
def test_viterbi_equals_the_best_of_all_sequences(n, seed):
    rng = np.random.default_rng(seed)
    emit, step = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
    score = lambda tags: sum(emit[i, t] for i, t in enumerate(tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:]))
    best = max(itertools.product((0, 1), repeat=n), key=score)
    assert tagger.viterbi(emit, step) == list(best)


def test_sentences_and_titles():
    text = "Dr. Ada O'Neil-Smith called Mr Wu. Then\nMs. Lee left! 42 x"
    sentences = [[t for _, _, t in s] for s in tagger.tokens_of(text)]
    assert sentences == [["Dr", ".", "Ada", "O'Neil-Smith", "called", "Mr", "Wu", "."], ["Then"], ["Ms", ".", "Lee", "left", "!"], ["42", "x"]]
    assert [[s[i] for i in tagger.titled_names(s)] for s in sentences] == [["Ada", "O'Neil-Smith", "Wu"], [], ["Lee"], []]
    assert all(text[a:b] == t for s in tagger.tokens_of(text) for a, b, t in s)
    assert max(map(len, tagger.tokens_of("a " * 1000))) == tagger.MOST_TOKENS


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(900):
        name, other = rng.choice(["", "Jonas ", "Mira ", "Olga "]) + rng.choice(SEEN), rng.choice(OTHER)
        line = rng.choice(WITH).format(rng.choice(["Mr. ", "Dr ", "Ms. ", ""]) + name)
        rows.append((f"{line} . {rng.choice(WITHOUT).format(other)}.",))
    rows += [(None,), ("",), ("x" * 100_000,)]
    return tagger.fit_names(spark.createDataFrame(rows, "text string").repartition(5), "text")


def test_names_without_a_title_that_were_never_seen(spark, fitted):
    rng = random.Random(10)
    rows = []
    for i in range(300):
        names = [rng.choice(UNSEEN)] if i % 2 else []
        line = rng.choice(WITH).format(names[0]) if names else rng.choice(WITHOUT).format(rng.choice(OTHER + ["Lisbon", "Keyboard"]))
        rows.append((i, line, names))
    table = spark.createDataFrame(rows, "id long, text string, names array<string>")
    found = table.select("text", "names", fitted(F.col("text")).alias("clean")).collect()
    hits = sum(r["clean"].count("[NAME]") for r in found if r["names"] and r["names"][0] not in r["clean"])
    marked, planted = sum(r["clean"].count("[NAME]") for r in found), sum(len(r["names"]) for r in found)
    assert hits / marked >= 0.95 and hits / planted >= 0.95


def test_odd_texts_and_no_lesson(spark, fitted):
    table = spark.createDataFrame([(None,), ("",), ("thank Ada Zielinski for the help",), ("no names here",)], "text string")
    assert [r[0] for r in table.select(fitted(F.col("text"))).collect()] == [None, "", "thank [NAME] for the help", "no names here"]
    none = tagger.fit_names(table, "text")
    assert [r[0] for r in table.select(none(F.col("text"))).collect()] == [r[0] for r in table.collect()]


def test_the_same_rows_teach_the_same_weights(spark):
    rows = [(f"please ask Mr. {n} about it",) for n in SEEN for _ in range(3)]
    a, b = (tagger.fit_names(spark.createDataFrame(rows, "text string").coalesce(1), "text").weights for _ in range(2))
    assert np.array_equal(a, b) and a.any()
