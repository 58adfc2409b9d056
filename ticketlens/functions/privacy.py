"""Removal of personal data that a pattern can recognize.

Of the names of persons, those after a form of address are recognized. Others are
beyond patterns; a caller who has a recognizer gives it to the normalization as
``Rules(names=…)``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Patterns = Sequence[tuple[str, str]]

# Applied in this order: a later pattern must not eat part of an earlier one.
# Only constructs that Java and RE2 read alike, so no look-around. A match begins and ends with a token: the
# character before it is captured and put back, the one after it too. Labels name groups as Java does.
_BEFORE, _AFTER = r"(^|[^\p{L}0-9.])", r"($|[^\p{L}0-9.]|\.(?:$|[^\p{L}0-9]))"
ADDRESS_PATTERNS: Patterns = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),)
NAME_PATTERNS: Patterns = (
    (r"(^|[^\p{L}])((?:Mr|Mrs|Ms|Dr|Prof)\.? )\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}", "$1$2[NAME]"),
)
# Each with a sign of it, a part that every match holds and that is quickly found missing.
_NUMBERS = (
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"[0-9]\.[0-9]{1,3}\.[0-9]", "[IP]"),
    (r"INV-[0-9]{4,}(?:-R[0-9]+)?", r"INV-[0-9]", "[INVOICE]"),
    (r"[A-Z]-[0-9]{4,}", r"[A-Z]-[0-9]{4}", "[CASE]"),
    (r"[A-Z][0-9]{6}", r"[A-Z][0-9]{6}", "[ORDER]"),
    (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]", "[ACCOUNT]"),
    (r"\+?\(?[0-9][0-9 ().-]{6,}[0-9]", r"[0-9][0-9 ().-]{6}", "[NUMBER]"),
)
NUMBER_PATTERNS: Patterns = tuple(
    (_BEFORE + pattern + _AFTER, f"$1{label}$2")
    for pattern, _, label in _NUMBERS
    for _ in range(2)  # neighbours share the character between them
)
_SIGNS = {_BEFORE + pattern + _AFTER: sign for pattern, sign, _ in _NUMBERS}
# Matches nothing, and by its length is given up without a look at the text.
_NEVER = r"(?!).{999999999}"
_PLAIN_LABEL = re.compile(r"(?:\$1)?\[[A-Z]+\](?:\$2)?")


def _replaced(text: Column, patterns: Patterns, original: Column | None = None) -> Column:
    """Each pattern in turn; a pattern that never matches for one whose sign ``original`` does not hold."""
    for pattern, label in patterns:
        if original is not None and pattern in _SIGNS:
            chosen = F.when(original.rlike(_SIGNS[pattern]), F.lit(pattern)).otherwise(F.lit(_NEVER))
            text = F.regexp_replace(text, chosen, F.lit(label))
        else:
            text = F.regexp_replace(text, pattern, label)
    return text


def redact(
    text: Column,
    addresses: Patterns = ADDRESS_PATTERNS,
    numbers: Patterns = NUMBER_PATTERNS,
    names: Patterns = NAME_PATTERNS,
) -> Column:
    """``text`` with personal data replaced by a label.

    An address holds an ``@``, a number a digit, a name here a form of address. Most texts have
    none, and a look for it is far cheaper than a pattern, so the patterns run only where it is
    found.
    """
    # Signs cannot arise on the way: what replaces a match is in brackets and has no digit.
    plain = all(_PLAIN_LABEL.fullmatch(label) for _, label in (*addresses, *numbers))
    clean = F.when(text.contains("@"), _replaced(text, addresses)).otherwise(text)
    clean = F.when(text.rlike("[0-9]"), _replaced(clean, numbers, text if plain else None)).otherwise(clean)
    return F.when(text.rlike("Mr|Ms|Dr|Prof"), _replaced(clean, names)).otherwise(clean)
