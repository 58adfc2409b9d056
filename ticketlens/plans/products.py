"""The product table: text vectors, image uris and image vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import card_text, embedding_text, is_filled, preview, public_url
from ..operators.columns import add_column_if_missing, fill_uri
from ..operators.embedding import embed, hashed_words
from ..operators.hot import left_join_hot
from ..operators.models import ColumnFunction
from ..sources.files import object_key, wanted_objects


def add_text_vectors(
    products: DataFrame,
    embedder: ColumnFunction | None = None,
    title_col: str = "title",
    desc_col: str = "description",
    out: str = "text_embedding",
    mode: str = "all",
) -> DataFrame:
    return embed(products, embedding_text(title_col, desc_col), embedder or hashed_words(), out, mode)


def add_uris(products: DataFrame, prefix: str, image_col: str = "image", uri_col: str = "uri") -> DataFrame:
    return fill_uri(add_column_if_missing(products, uri_col, "string"), prefix, image_col, uri_col)


def add_image_vectors(
    products: DataFrame,
    objects: DataFrame,
    image_embedder: ColumnFunction,
    uri_col: str = "uri",
    out: str = "img_embedding",
) -> DataFrame:
    """Vectors of the images the products point at.

    Each image is read and embedded once, however many products show it, and
    only its vector travels to them. Products without a uri, or with one that very many
    share, make no large group. A product whose image is not found keeps the vector it had.
    """
    products = add_column_if_missing(products, out, schemas.VECTOR)
    images = wanted_objects(objects, products, uri_col).select(
        "object_key", image_embedder(F.col("content")).alias("_vector")
    )
    key = F.when(is_filled(F.col(uri_col)), object_key(F.col(uri_col)))
    return left_join_hot(products.withColumn("object_key", key), images, "object_key").select(
        *[F.coalesce("_vector", out).alias(out) if c == out else F.col(c) for c in products.columns]
    )


def build_products(
    products: DataFrame,
    embedder: ColumnFunction | None = None,
    image_prefix: str = "",
    objects: DataFrame | None = None,
    image_embedder: ColumnFunction | None = None,
) -> DataFrame:
    """Text vectors, then uris, then image vectors where images are given."""
    built = add_uris(add_text_vectors(products, embedder), image_prefix)
    if objects is not None and image_embedder is not None:
        return add_image_vectors(built, objects, image_embedder)
    return add_column_if_missing(built, "img_embedding", schemas.VECTOR)


def product_cards(found: DataFrame) -> DataFrame:
    """What a result card shows: title, short description and a public image address."""
    return found.select(
        "product_id",
        card_text(F.col("title")).alias("title"),
        preview(card_text(F.col("description"))).alias("preview"),
        public_url(F.col("uri")).alias("image_url"),
    )
