"""Row-local text expressions shared by the plans. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank around a comment, and the public address
# of an object-store path.
BLANKS = " \t\n\r"
OBJECT_SCHEME = "gs://"
PUBLIC_ADDRESS = "https://storage.googleapis.com/"

# Read alike by Java, Arrow and DuckDB.
NOT_LETTERS = r"[^\p{L}]+"


def strip_blanks(text: Column) -> Column:
    """Trim every kind of whitespace; ``trim`` alone removes only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def is_filled(text: Column) -> Column:
    """Non-null and non-empty. A lone space counts as filled."""
    return text.isNotNull() & (text != "")


def ticket_text(subject: str = "subject", body: str = "body") -> Column:
    """``subject body``, or whichever of the two is present, or ''.

    ``concat`` is NULL as soon as one side is, which is what makes the
    fallbacks reachable; ``concat_ws`` would skip NULLs instead.
    """
    s, b = F.col(subject), F.col(body)
    return F.coalesce(F.concat(s, F.lit(" "), b), b, s, F.lit(""))


def embedding_text(first: str, second: str) -> Column:
    """Both parts with NULL read as empty, joined by one space."""
    return F.concat(F.coalesce(F.col(first), F.lit("")), F.lit(" "), F.coalesce(F.col(second), F.lit("")))


def filled_comments(comments: Column) -> Column:
    """The non-blank comments, trimmed, in their order. No explode, no shuffle."""
    return F.filter(F.transform(comments, strip_blanks), lambda c: F.length(c) > 0)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int = 200) -> Column:
    """The first ``n`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > n, F.concat(first_chars(text, n), F.lit("…"))).otherwise(text)


def card_text(value: Column) -> Column:
    """Any value as text for display; NULL becomes ''."""
    return F.coalesce(value.cast("string"), F.lit(""))


def public_url(uri: Column) -> Column:
    return F.regexp_replace(uri, f"^{OBJECT_SCHEME}", PUBLIC_ADDRESS)


def with_slash(prefix: str) -> str:
    """``prefix`` ending in a slash; an empty prefix stays empty."""
    return prefix if not prefix or prefix.endswith("/") else prefix + "/"


def words(text: Column) -> Column:
    """The lower-cased runs of letters in ``text``, possibly with an empty string at either end."""
    return F.split(F.lower(text), NOT_LETTERS)


def has_word(words: Column, lexicon: Sequence[str]) -> Column:
    if not lexicon:
        return F.lit(False)
    return F.arrays_overlap(words, F.array(*[F.lit(word) for word in lexicon]))


def count_words(words: Column, lexicon: Sequence[str]) -> Column:
    """How many of ``words`` are in the lexicon, repeats included."""
    return F.size(F.filter(words, lambda word: word.isin(*lexicon)))
