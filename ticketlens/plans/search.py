"""Product and ticket search by meaning, for one query or a table of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import keep_present
from ..operators.embedding import embed, hashed_words
from ..operators.knn import Side, knn, nearest_to_vector
from ..operators.models import ColumnFunction

PRODUCT_COLUMNS = ("product_id", "title", "categories", "description", "uri")
#: Found rows (an id, a query id, two numbers) that are sent to every task.
MOST_SHOWN = 200_000
TICKET_COLUMNS = ("ticket_id", "subject", "body", "answer", "type", "priority", "source")


def embed_queries(queries: DataFrame, text_col: str, embedder: ColumnFunction | None = None) -> DataFrame:
    """Queries with their vector, in the space of the table they will search."""
    return embed(queries, F.col(text_col), embedder or hashed_words(), "query_embedding")


def embed_images(objects: DataFrame, image_embedder: ColumnFunction) -> DataFrame:
    """Uploaded pictures (see ``sources.files.list_objects``) as queries: path and vector."""
    return objects.select("path", image_embedder(F.col("content")).alias("query_embedding"))


def search(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    base_id: str,
    base_vector: str,
    query_id: str,
    query_vector: str,
    columns: Sequence[str],
    **options,
) -> DataFrame:
    """(query_id, rank, distance, columns of the found row), by query and rank.

    The search itself moves only ids and vectors; what is displayed is joined
    back for the found rows. There are ``k`` per query at most; while that is no more than
    ``MOST_SHOWN`` rows, they go to every task and the base is not shuffled. Eager: it counts the queries.
    """
    found = knn(Side(base, base_id, base_vector), Side(queries, query_id, query_vector), k, **options)
    found = found.withColumnRenamed("base_id", base_id)
    if queries.count() * k <= MOST_SHOWN:
        found = F.broadcast(found)
    shown = keep_present(base, dict.fromkeys((base_id, *columns)))
    return shown.join(found, base_id).select(
        "query_id", "rank", "distance", *shown.columns
    )


def search_products(
    products: DataFrame, queries: DataFrame, query_id: str, query_vector: str,
    k: int = 9, base_vector: str = "text_embedding", **options,
) -> DataFrame:
    """Products nearest to each query, by text vector or by image vector."""
    return search(products, queries, k, "product_id", base_vector, query_id, query_vector, PRODUCT_COLUMNS, **options)


def search_tickets(
    tickets: DataFrame, queries: DataFrame, query_id: str, query_vector: str,
    k: int = 3, channel: str | None = None, base_id: str = "ticket_id", **options,
) -> DataFrame:
    """Past tickets nearest to each issue, of one channel or of all."""
    if channel is not None:
        tickets = tickets.where(F.col("source") == channel)
    return search(tickets, queries, k, base_id, "text_embedding", query_id, query_vector, TICKET_COLUMNS, **options)


def products_like(products: DataFrame, vector: Sequence[float], k: int = 9, base_vector: str = "text_embedding", metric: str = "euclidean") -> DataFrame:
    """Products nearest to one vector, such as that of an uploaded image."""
    found = nearest_to_vector(products, vector, k, "product_id", base_vector, metric)
    return keep_present(found, (*PRODUCT_COLUMNS, "distance"))


def tickets_like(tickets: DataFrame, vector: Sequence[float], k: int = 3, channel: str | None = None, metric: str = "euclidean") -> DataFrame:
    if channel is not None:
        tickets = tickets.where(F.col("source") == channel)
    found = nearest_to_vector(tickets, vector, k, "ticket_id", "text_embedding", metric)
    return keep_present(found, (*TICKET_COLUMNS, "distance"))
