"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs`` (clashing names of extra columns included), in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, langid, minmax, packing, substring
from ticketlens.llm.queries import read, tokenizer_files
from ticketlens.operators.ids import dense_ids
from ticketlens.session import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the language of each text as its lang; without the documents that have no letter, which belong to no language.

    Learns from the documents' own text and lang. The language that the text is told to be in replaces a null or another lang; where none is told, such as in a
    script that none of the learned ones has, the document stays as it is.
    """
    return langid.labelled(docs, langid.fit_languages(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8 or more.

    The one of the smallest doc_id stays. Rows without a doc_id stay. Where rows repeat a doc_id, each of its different texts
    is a document of its own: the decision is by (doc_id, text), in that order.
    """
    rule = minmax.NearRule(shingle=5, percent=80)
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = minmax.near_duplicates(named, rule).where("kept").select("doc_id")
        return named.join(kept, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    order = [F.col("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"), F.col("text").isNull().alias("none")]
    numbered = settle(dense_ids(named.select(whole, *order), ["id", "digest", "none"], "number"), "numbered")
    kept = minmax.near_duplicates(numbered.select(F.col("number").alias("doc_id"), "whole.text"), rule).where("kept")
    one = numbered.join(kept.select(F.col("doc_id").alias("number")), "number", "left_semi")
    # Texts without a word are alike to none, so copies of such a row are all kept until here.
    blank = F.struct("id", "digest", "none")
    first = numbered.groupBy(blank.alias("same")).agg(F.min("number").alias("number")).select("number")
    return one.join(first, "number", "left_semi").select("whole.*").select(docs.columns).union(docs.where("doc_id is null"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of windows of 35 words that also start elsewhere; no document goes.

    A changed text has its words one space apart, and n_chars follows it.
    """
    # Other columns travel under neutral names, which no column that the operator adds can clash with.
    inner = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    clean = substring.remove_repeats(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in inner.items()]), window=35)
    values = {c: F.col(name) for c, name in inner.items()} | {"text": F.col("kept_text")}
    if "n_chars" in inner:
        length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(values["n_chars"])
        values["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return clean.select(*[value.alias(c) for c, value in values.items()])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, copied or edited."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence of 2048 tokens."""
    return packing.pack(packing.pieces(docs, **tokenizer_files(), length=2048, end_id=1), length=2048)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: No SQL twin: learned languages and token ids are not for SQL. Tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
