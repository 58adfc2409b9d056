"""Explicit schemas of every table the package reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


VECTOR = T.ArrayType(T.DoubleType())

CHATS = T.StructType(_strings("chat"))
EMAILS = T.StructType(_strings("email"))
FORMS = T.StructType(_strings("subject", "body", "answer", "type", "priority"))
TRANSCRIPTS = T.StructType(_strings("transcripts"))
TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
PRODUCTS = T.StructType(
    _strings("product_id", "title", "features", "description")
    + [T.StructField("price", T.DoubleType())]
    + _strings("image")
    + [T.StructField("categories", T.ArrayType(T.StringType()))]
    + _strings("details")
    + [T.StructField("customer_comments", T.ArrayType(T.StringType()))]
)

# The record every channel is normalized to.
RECORD = T.StructType(_strings("source", "source_key", "subject", "body", "answer", "type", "priority"))

TICKETS = T.StructType(
    [T.StructField("ticket_id", T.LongType())]
    + RECORD.fields
    + [T.StructField("text_embedding", VECTOR)]
)
