"""Churn figures from stored partial aggregates: a report reads a few rows, not all scores.

A batch of scored tickets is summed up once, per group, as counts, a sum and a quantile sketch. All of these merge: batches can be
appended as they come, and rolled up over any groups at read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import sum_where, unit_clamp

#: Values a sketch keeps at its top level; the default gives a rank error of 0.0014.
SKETCH_SIZE = 2048


def rank_error(size: int = SKETCH_SIZE) -> float:
    """By how much, as a share of all rows, the rank of a quantile read off a sketch may be wrong, with a confidence of 99 %.

    As the library that the sketches come from states it for KLL sketches (Karnin, Lang and Liberty, 2016). Up to ``size`` values all are
    kept, and it is exact.
    """
    return 2.296 / size**0.9723


def churn_partials(scored: DataFrame, by: Sequence[str], high_threshold: float = 0.7, size: int = SKETCH_SIZE) -> DataFrame:
    """One row per group of ``by``: counts, the sum and a sketch of the risks. One pass with map-side combining."""
    risk = unit_clamp(F.col("churn"))
    return scored.select(*by, risk.alias("risk")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count("risk").alias("n_scored"),
        F.coalesce(F.sum("risk"), F.lit(0.0)).alias("sum_risk"),
        sum_where(F.col("risk") >= high_threshold).alias("high_risk_count"),
        F.kll_sketch_agg_double("risk", F.lit(size)).alias("sketch"),
    )


def merge_partials(partials: DataFrame, by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Partial aggregates of the groups ``by``, or of everything, from those of smaller groups or of batches."""
    counts = [F.sum(c).alias(c) for c in ("total_tickets", "n_scored", "sum_risk", "high_risk_count")]
    return partials.groupBy(*by).agg(*counts, F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def _quantile(share: float) -> Column:
    return F.when(F.col("n_scored") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))


def churn_kpis_of(partials: DataFrame, by: Sequence[str] = (), share: float = 0.9) -> DataFrame:
    """avg_risk, p90_risk, high_risk_count, total_tickets, as ``ticket_reports.churn_kpis`` gives them; p90_risk within :func:`rank_error`."""
    merged = merge_partials(partials, by)
    return merged.select(
        *by, F.try_divide("sum_risk", "n_scored").alias("avg_risk"), _quantile(share).alias("p90_risk"), "high_risk_count", "total_tickets"
    )
