"""One registered query per operator, over the whole of its intended table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, spread
from . import classlm, decontaminate, langid, minmax, packing, quality, runs, sharding, substring, tokencounts, toxicity, tries, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def fold(folds: int) -> Column:
    """Which of the folds a document belongs to."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op2_pack_sequences(spark, sf):
    cut = packing.pieces(read(spark, sf, "documents"), **tokenizer_files(), length=2048, end_id=1)
    return packing.pack(cut, length=2048)


@query
def op9_language_id(spark, sf):
    docs = read(spark, sf, "documents")
    model = langid.fit_languages(docs.where(fold(4) != 2))
    found = langid.predict_languages(docs, model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op5_shard_ring(spark, sf):
    placed = sharding.shard(read(spark, sf, "documents"), shards=16, virtual_nodes=256, slack=0.0)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query
def op8_minmax_near_duplicates(spark, sf):
    return minmax.near_duplicates(read(spark, sf, "documents"), minmax.NearRule(shingle=4, percent=80))


@query
def op6_remove_repeats(spark, sf):
    cleaned = substring.remove_repeats(read(spark, sf, "documents"), window=35, keep_text=False)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_benchmark_leaks(spark, sf):
    return decontaminate.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query
def op4_near_vectors(spark, sf):
    return vectors.near_vectors(read(spark, sf, "embeddings"), vectors.CosineRule(threshold=0.98))


ORACLE_SQL["op4_near_vectors"] = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT e.vec_id, least(e.vec_id, coalesce(min(r.b), e.vec_id)) AS component_id
    FROM embeddings e LEFT JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
)
SELECT l.vec_id, (SELECT count(*) FROM links WHERE a = l.vec_id) AS n_links, l.component_id, l.vec_id = l.component_id AS kept
FROM least l
"""


ORACLE_SQL["op6_remove_repeats"] = """
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35
), windows AS (
    SELECT doc_id, i, list_slice(w, i, i + 34) AS seq FROM starts
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY seq) AS n FROM windows) WHERE n > 1
), gone AS (
    SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(0, 35) t(k)
), words AS (
    SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""


@query
def op1_quality(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = quality.fit_quality(docs, labels.where(fold(5) != 0).select("doc_id", F.col("quality").alias("label")))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_toxicity(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(fold(3) != 1).select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


@query
def op7_class_model(spark, sf):
    docs = read(spark, sf, "documents")
    model = classlm.fit_classes(docs.where(fold(5) != 1))
    scored = classlm.score_texts(docs, model)
    return scored.withColumns({"held_out": fold(5) == 1, "train_tokens": F.lit(model.train_tokens).cast("long")})


@query
def op12_token_counts(spark, sf):
    docs = spread(read(spark, sf, "documents")).select("doc_id", F.col("text").cast("string").alias("text"))
    counted = tokencounts.token_counts(docs, piece_model())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Makes one document in ten periodic from some word on, as the contract of operator 11 says."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


@query
def op11_periodic_runs(spark, sf):
    found = runs.periodic_runs(spread(read(spark, sf, "documents")), plant_period)
    best = found.withColumn("best", runs.most_repeated(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.try_divide(F.col("best.length") * 1000, F.col("best.period"))).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def rebuilt_turns(numbered: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 20 before its own turns after its first h, as the contract of operator 13 says."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    convs = numbered.select("conv_id").distinct().withColumn("h", h)
    heads = numbered.where("conv_id % 20 = 0 and position <= 3").select(F.col("conv_id").alias("head"), "position", "turn", "words")
    taken = convs.where("h > 0").join(heads, (F.expr("conv_id - conv_id % 20") == F.col("head")) & (F.col("position") <= F.col("h")))
    columns = ["conv_id", "side", "position", "turn", "words"]
    own = numbered.where(F.col("position") > h).withColumn("side", F.lit(1))
    return taken.withColumn("side", F.lit(0)).select(columns).union(own.select(columns))


@query
def op13_prefix_trie(spark, sf):
    numbered = settle(tries.turn_digests(read(spark, sf, "conversations")), "turns")
    return tries.prefix_trie(rebuilt_turns(numbered), ["side", "position"], numbered.select("conv_id"))


# CRC-32 of a number's digits in DuckDB, bit by bit: -1 stands for one shift.
_CRC32 = """list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(str_split(c::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384::BIGINT * (r & 1)) END)"""

ORACLE_SQL["op13_prefix_trie"] = f"""
WITH own AS (
    SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hex AS (
    SELECT c, t, c - c % 20 AS head, xor({_CRC32}, 4294967295) % 4 AS h FROM own
), rebuilt AS (
    SELECT a.c, list_concat(coalesce(list_slice(b.t, 1, a.h), []), list_slice(a.t, a.h + 1, len(a.t))) AS t
    FROM hex a LEFT JOIN own b ON b.c = a.head
), prefixes AS (
    SELECT c, d, list_slice(t, 1, d) AS prefix, len(t) = d AS ends, CASE WHEN d > 0 THEN t[d].text ELSE '' END AS last_text
    FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), named AS (
    SELECT *, min(c) OVER (PARTITION BY d, prefix) AS node FROM prefixes
), nodes AS (
    SELECT node, d, count(*) AS n_convs, any_value(len(regexp_extract_all(last_text, '[^\\x20\\x09-\\x0D]+'))) AS words,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
    FROM named GROUP BY node, d
), parents AS (
    SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN named p ON p.c = n.node AND p.d = n.d - 1
), kids AS (
    SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY ALL
), own_values AS (
    SELECT p.*, coalesce(k.n_children, 0) AS n_children, (k.n_children IS NULL)::BIGINT AS leaf, (n_convs - 1) * words AS saved
    FROM parents p LEFT JOIN kids k USING (node, d)
), sums AS (
    SELECT a.node, a.d, sum(v.leaf)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
    FROM own_values v JOIN named a ON a.c = v.node AND a.d <= v.d GROUP BY a.node, a.d
)
SELECT v.node AS conv_id, v.d AS depth, v.parent AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM own_values v JOIN sums s USING (node, d)
"""
