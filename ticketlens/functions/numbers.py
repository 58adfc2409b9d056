"""Row-local numeric expressions: rates, the risk clamp and the risk buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds and labels of the churn-risk buckets. The dash is
# U+2013, and the last bucket includes its upper bound.
RISK_BUCKETS = (
    (0.2, "[0.0–0.2)"),
    (0.4, "[0.2–0.4)"),
    (0.6, "[0.4–0.6)"),
    (0.8, "[0.6–0.8)"),
)
TOP_BUCKET = "[0.8–1.0]"


def share(part: Column, whole: Column) -> Column:
    """``part / whole``; NULL when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def unit_clamp(x: Column) -> Column:
    """``x`` limited to [0, 1]; NULL and NaN give NULL.

    The guard matters: ``least``/``greatest`` skip NULLs and would turn an
    unscored row into a risk of 0.
    """
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def risk_bucket(risk: Column, null_bucket: str = "top") -> Column:
    """One of five labels. Unscored rows go to the top bucket, or with
    ``null_bucket="unscored"`` to a label of their own."""
    if null_bucket not in ("top", "unscored"):
        raise ValueError(f"null_bucket must be 'top' or 'unscored', not {null_bucket!r}")
    (bound, label), *rest = RISK_BUCKETS
    chain = F.when(risk < bound, label)
    for bound, label in rest:
        chain = chain.when(risk < bound, label)
    if null_bucket == "unscored":
        chain = chain.when(risk.isNull(), "unscored")
    return chain.otherwise(TOP_BUCKET)


def number_or_zero(x: Column) -> Column:
    """``x`` with NULL and NaN shown as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def percent(x: Column) -> Column:
    """``x`` as a percentage with one decimal, halves to even."""
    return F.bround(x * 100, 1)


def count_where(condition: Column) -> Column:
    """Rows where ``condition`` holds; 0 on empty input."""
    return F.count_if(condition)


def sum_where(condition: Column) -> Column:
    """Like ``count_where``, but NULL on empty input, as a SUM over CASE is."""
    return F.sum(F.when(condition, 1).otherwise(0))
