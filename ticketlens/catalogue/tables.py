"""The package's input tables, derived from the driver's parquet tables.

Each function here has a twin of the same name in ``oracle.py`` that derives
the same rows in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embedding_text
from ..operators.embedding import embed, hashed_words
from ..operators.normalize import Rules
from ..operators.scoring import abuse_scorer, churn_scorer, satisfaction_scorer, sentiment_scorer
from ..operators.transcripts import assemble_transcripts
from ..plans.learned import TicketGraph
from ..plans.learned import ticket_graph as build_ticket_graph
from ..plans.product_reports import score_products
from ..plans.replies import Contact
from ..plans.ticket_reports import score_tickets
from ..plans.tickets import Channels, add_ticket_vectors, number_tickets, records, unify
from ..session import settle, spread
from . import lexicons

RULES = Rules(types=lexicons.TYPES, priorities=lexicons.PRIORITIES)

CONTACT = Contact("help@example.com", "+1 555 0100")

_graphs: dict[tuple[str, str], TicketGraph] = {}
_stored: dict[tuple[str, str, str], DataFrame] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, over all cores: much work is done on each."""
    return spread(read(spark, sf, "documents"))


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A derived table, written on first use and read from then on, the way the
    ticket and score tables are built once and then reported on."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = settle(build(spark, sf), name)
    return _stored[key]


def document_fields(spark: SparkSession, sf: str) -> DataFrame:
    """First line, middle lines and last line of every document."""
    lines = F.split("text", "\n")
    middle = F.slice("lines", 2, F.greatest(F.size("lines") - 2, F.lit(0)))
    return documents(spark, sf).withColumn("lines", lines).select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "lines",
        F.element_at("lines", 1).alias("subject"),
        F.array_join(middle, " ").alias("body"),
        F.element_at("lines", -1).alias("answer"),
    )


def forms(fields: DataFrame) -> DataFrame:
    """The other documents as form submissions, with types and priorities as people typed them."""
    n = F.col("n_chars")
    priority = F.when(n > 6000, "urgent").when(n > 3000, "High").when(n > 1500, "medium").when(n > 700, "p1")
    return (
        fields.where(~F.coalesce("lang", F.lit("")).isin("fr", "es", "de"))
        .select("subject", "body", "answer", F.col("source").alias("type"), priority.alias("priority"))
    )


def emails(fields: DataFrame) -> DataFrame:
    """French and Spanish documents as raw emails, in quotes, with \\n as two characters.

    Quoted lines stand above and below the text, every turn has a signature or closing, and the customer writes twice.
    """
    parts = [
        F.lit('"Subject: '), F.col("subject"),
        F.lit("\\nFrom: Ada Doe <ada@example.com>\\nTo: Support <help@example.com>\\nCustomer: > an earlier line\\n"), F.col("body"),
        F.lit("\\nOn Monday Ada wrote:\\n> another one\\nBest regards, Ada Doe\\nSupport: Hello Ada, "), F.col("answer"),
        F.lit("\\n-- \\nSupport team\\nThis message is confidential.\\nCustomer: "), F.col("source"),
        F.lit(" asks again\\nThanks, but From: here on it is new\\nThank you,\\nAda\""),
    ]
    return fields.where(F.col("lang").isin("fr", "es")).select(F.concat(*parts).alias("email"))


def calls(fields: DataFrame) -> DataFrame:
    """German documents as call transcripts, with a line that begins like an email's header."""
    parts = [
        F.lit("Customer: "), F.col("subject"), F.lit("\nTo: "), F.col("source"),
        F.lit("\nCustomer: "), F.col("body"), F.lit("\nAgent: "), F.col("answer"),
    ]
    return fields.where(F.col("lang") == "de").select(F.concat(*parts).alias("transcripts"))


def chats(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as raw chats, in quotes, with \\n as two characters.

    Blocks of two turns, so that conversations go over several.
    """
    turns = read(spark, sf, "conversations")
    lines = assemble_transcripts(turns, block_turns=2, separator="\\n")
    return lines.select(F.concat(F.lit('"'), "transcripts", F.lit('"')).alias("chat"))


def channels(spark: SparkSession, sf: str) -> Channels:
    fields = document_fields(spark, sf)
    return Channels(forms=forms(fields), chats=chats(spark, sf), emails=emails(fields), calls=calls(fields))


def unified(spark: SparkSession, sf: str) -> DataFrame:
    return unify(spark, records(channels(spark, sf), RULES))


def build_tickets(spark: SparkSession, sf: str) -> DataFrame:
    return add_ticket_vectors(number_tickets(unified(spark, sf)))


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "tickets", build_tickets)


def ticket_graph(spark: SparkSession, sf: str) -> TicketGraph:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _graphs:
        _graphs[key] = build_ticket_graph(tickets(spark, sf), k=5)
    return _graphs[key]


def sentiment() -> Callable[[Column], Column]:
    return sentiment_scorer(lexicons.NEGATIVE, lexicons.POSITIVE)


def churn() -> Callable[[Column], Column]:
    return churn_scorer(lexicons.NEGATIVE)


def abuse() -> Callable[[Column], Column]:
    return abuse_scorer(lexicons.ABUSIVE)


def satisfaction() -> Callable[[Column], Column]:
    return satisfaction_scorer(lexicons.NEGATIVE, lexicons.POSITIVE)


def scored_tickets(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "scored_tickets",
        lambda spark, sf: score_tickets(tickets(spark, sf), sentiment(), churn()),
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as products: lines as comments, some of them blank or missing."""
    blanks = F.array(F.lit(""), F.lit("   "), F.lit(None).cast("string"), F.lit("\t"))
    comments = (
        F.when((F.col("lang") == "es") & (F.col("n_chars") < 500), blanks)
        .when(F.col("lang") == "de", F.concat(blanks, "lines"))
        .when((F.col("lang") == "fr") & (F.col("n_chars") < 500), F.lit(None))
        .otherwise(F.col("lines"))
    )
    image = F.when(F.col("lang") == "de", "").when(F.col("lang") != "fr", F.concat("source", F.lit(".jpg")))
    preset = F.when(F.col("lang") == "es", F.concat(F.lit("gs://catalogue/"), F.col("doc_id").cast("string"), F.lit(".png")))
    return document_fields(spark, sf).select(
        F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("product_id"),
        F.when(F.col("subject") != "", F.col("subject")).alias("title"),
        F.when(F.col("body") != "", F.col("body")).alias("description"),
        image.alias("image"),
        preset.alias("uri"),
        comments.alias("customer_comments"),
    )


def scored_products(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "scored_products",
        lambda spark, sf: score_products(products(spark, sf), abuse(), satisfaction()),
    )


def product_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "product_vectors",
        lambda spark, sf: embed(products(spark, sf), embedding_text("title", "description"), hashed_words()),
    )


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as customer questions, with their vectors."""
    return embed(read(spark, sf, "benchmark"), F.col("text"), hashed_words(), "query_embedding")


def image_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


def customer_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on customers: (c_custkey, text, clean). The first line addresses them by a title, except for every fifth; the second does not.

    Their names are letters made from their numbers; ``clean`` has [NAME] in place of them.
    """
    letters = F.translate(F.substring(F.md5("c_name"), 1, 7), "0123456789", "ghijklmnop")
    customers = read(spark, sf, "customer").select("c_custkey", "c_nationkey", F.initcap(letters).alias("name"))
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.initcap("n_name").alias("nation"))
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, "Dr. ").when(k % 3 == 1, "Mrs ").otherwise("Mr. ")

    def note(name: Column) -> Column:
        first = F.concat(title, name, F.lit(" asked about an order from "), F.col("nation"), F.lit(".\n"))
        second = F.when(k % 2 == 0, F.concat(F.lit("please call "), name, F.lit(" back today."))).otherwise(F.concat(name, F.lit(" wants the invoice for "), F.col("nation"), F.lit(".")))
        return F.concat(F.when(k % 5 != 0, first).otherwise(""), second)

    return customers.join(nations, "c_nationkey").select("c_custkey", note(F.col("name")).alias("text"), note(F.lit("[NAME]")).alias("clean"))


def vector_code(vector: Column) -> Column:
    """A vector as text, in millionths, so that both engines print it alike."""
    return F.array_join(F.transform(vector, lambda x: F.floor(x * 1_000_000).cast("string")), ",")
