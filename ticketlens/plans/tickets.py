"""The unified ticket table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import embedding_text, is_filled
from ..operators.embedding import embed, hashed_words
from ..operators.ids import dense_ids
from ..operators.models import ColumnFunction
from ..operators.normalize import Rules, call_parts, chat_parts, email_parts, extract, forms_passthrough, to_records, transcribe
from ..session import settle


@dataclass(frozen=True)
class Channels:
    """The raw inputs. An absent one contributes no tickets."""

    forms: DataFrame | None = None
    chats: DataFrame | None = None
    emails: DataFrame | None = None
    calls: DataFrame | None = None


def records(channels: Channels, rules: Rules = Rules(), extractor: ColumnFunction | None = None) -> list[DataFrame]:
    """Normalized records of the present channels: of the forms, and of all raw texts."""
    raw = [
        (df, text_col, source, parts)
        for df, text_col, source, parts in (
            (channels.chats, "chat", "chat", chat_parts),
            (channels.emails, "email", "email", email_parts),
            (channels.calls, "transcripts", "call", call_parts),
        )
        if df is not None
    ]
    found = [] if channels.forms is None else [forms_passthrough(channels.forms)]
    if raw and extractor:
        found += [extract(df, text_col, source, extractor) for df, text_col, source, _ in raw]
    elif raw:
        found.append(to_records(reduce(DataFrame.unionByName, [parts(df, text_col) for df, text_col, _, parts in raw]), rules))
    return found


def unify(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Union of the parts, without records that lack subject, body or answer.

    Catalyst pushes the filter into the branches.
    """
    if not parts:
        return spark.createDataFrame([], schemas.RECORD)
    names = schemas.RECORD.fieldNames()
    whole = reduce(DataFrame.unionByName, [part.select(*names) for part in parts])
    return whole.where(is_filled(F.col("subject")) & is_filled(F.col("body")) & is_filled(F.col("answer")))


def number_tickets(unified: DataFrame) -> DataFrame:
    """Dense ids in (source, source_key) order: the same input gets the same ids."""
    return dense_ids(unified, ["source", "source_key"], "ticket_id")


def add_ticket_vectors(tickets: DataFrame, embedder: ColumnFunction | None = None, mode: str = "all") -> DataFrame:
    return embed(tickets, embedding_text("subject", "body"), embedder or hashed_words(), "text_embedding", mode)


def calls_from_audio(objects: DataFrame, transcriber: ColumnFunction) -> DataFrame:
    """The ``calls`` channel of an object listing (see ``sources.files.list_objects``): one transcript per file.

    Written once: transcription is the dearest step, and later steps read its result more than once. Eager.
    """
    return settle(transcribe(objects, transcriber).select("transcripts"), "transcripts")


def build_tickets(
    spark: SparkSession,
    channels: Channels,
    rules: Rules = Rules(),
    extractor: ColumnFunction | None = None,
    embedder: ColumnFunction | None = None,
) -> DataFrame:
    """The whole ticket table, vectors included, ready for one write."""
    unified = unify(spark, records(channels, rules, extractor))
    return add_ticket_vectors(number_tickets(unified), embedder)
