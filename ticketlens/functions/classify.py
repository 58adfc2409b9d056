"""Keyword rules for ticket type and priority. The first matching rule wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_word

Rules = Sequence[tuple[str, Sequence[str]]]

# The ticket types and priorities, and the priorities counted as
# urgent. The keywords beside them are defaults a caller may replace.
OTHER_TYPE = "Other"
TYPE_RULES: Rules = (
    ("Billing and Payments", ("refund", "refunded", "invoice", "charge", "charged", "payment", "billing", "price", "discount", "installment")),
    ("Technical Support", ("error", "broken", "firmware", "install", "installation", "warranty", "repair", "setup", "crash", "missing")),
    ("Account & Access", ("password", "login", "account", "locked", "username", "loyalty", "points")),
    ("Shipping & Returns", ("shipping", "shipment", "shipped", "ship", "delivery", "deliver", "return", "exchange", "tracking", "address", "cancel")),
    ("Product Inquiry", ("compatible", "compatibility", "specs", "available", "stock", "quote", "release", "backorder")),
)
LOWEST_PRIORITY = "low"
PRIORITY_RULES: Rules = (
    ("high", ("urgent", "immediately", "asap", "stuck", "locked", "fraud", "broken", "today")),
    ("medium", ("wrong", "missing", "delay", "delayed", "cancel", "refund", "change")),
)
URGENT_PRIORITIES = ("high", "urgent", "p1", "critical")


def first_match(words: Column, rules: Rules, default: str) -> Column:
    """The label of the first rule with a keyword among ``words`` (see ``text.words``)."""
    chain = None
    for label, keywords in rules:
        hit = has_word(words, keywords)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def ticket_type(words: Column, rules: Rules = TYPE_RULES) -> Column:
    return first_match(words, rules, OTHER_TYPE)


def ticket_priority(words: Column, rules: Rules = PRIORITY_RULES) -> Column:
    return first_match(words, rules, LOWEST_PRIORITY)


def is_urgent(priority: Column) -> Column:
    return F.lower(F.coalesce(priority, F.lit("unknown"))).isin(*URGENT_PRIORITIES)
