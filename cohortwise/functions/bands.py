"""Bands: each is an order number plus a text, both NULL outside every band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise.functions.scalars import as_column, clip

# Edges (right-closed), labels and limits of the reports.
TIMING_EDGES = [-200.0, -1.0, 6.0, 24.0, 200.0]
TIMING_LABELS = ["Late", "<6h", "6–24h", ">24h"]
AGE_EDGES = [0.0, 19.0, 22.0, 25.0, 30.0, 100.0]
AGE_LABELS = ["≤19", "20–22", "23–25", "26–30", "31+"]
QUARTILE_LABELS = ["Q1 Low", "Q2", "Q3", "Q4 High"]
STRONG_R, MODERATE_R = 0.6, 0.3
TREND_MARGIN = 5.0
SLOPE_MARGIN = 0.05
OVERCOUNT_LIMIT = 40.0


def cut_order(col: Column | str, edges: Sequence[float]) -> Column:
    """Number of the right-closed bin (1-based) holding the value, else NULL."""
    value = as_column(col)
    order = F.when(value <= F.lit(edges[0]), F.lit(None).cast("int"))
    for number, upper in enumerate(edges[1:], start=1):
        order = order.when(value <= F.lit(upper), F.lit(number))
    return order


def band_label(order: Column | str, labels: Sequence[str]) -> Column:
    number = as_column(order)
    return F.when(
        number.isNotNull(), F.try_element_at(F.array(*[F.lit(x) for x in labels]), number)
    )


def timing_order(hours: Column | str) -> Column:
    """Submission-timing band; buffers of -200 h and less fall outside."""
    return cut_order(clip(hours, TIMING_EDGES[0], TIMING_EDGES[-1]), TIMING_EDGES)


def timing_band(hours: Column | str) -> Column:
    return band_label(timing_order(hours), TIMING_LABELS)


def age_order(age: Column | str) -> Column:
    return cut_order(age, AGE_EDGES)


def age_band(age: Column | str) -> Column:
    return band_label(age_order(age), AGE_LABELS)


def quantile_bin(rank: Column | str, n: Column, bins: int = 4) -> Column:
    """Bin of a 1-based rank among ``n`` when ranks are cut at equal quantiles.

    The cut points interpolate between ranks, so a rank on a cut point stays in
    the lower bin: bin = ceil(bins * (rank - 1) / (n - 1)), at least 1.
    """
    before = F.lit(bins) * (as_column(rank) - 1)
    ceiling = F.ceil(before / F.nullif(n - 1, F.lit(0)))
    return F.greatest(F.lit(1), F.coalesce(ceiling, F.lit(1)).cast("int"))


def strength(r: Column | str) -> Column:
    """Word for a correlation; a missing one reads as Weak."""
    size = F.abs(as_column(r))
    return (
        F.when(size > STRONG_R, "Strong").when(size > MODERATE_R, "Moderate").otherwise("Weak")
    )


def trend_word(delta: Column | str, margin: float = TREND_MARGIN) -> Column:
    change = as_column(delta)
    return (
        F.when(change > margin, "improving").when(change < -margin, "declining").otherwise("flat")
    )


def direction(slope: Column | str, margin: float = SLOPE_MARGIN) -> Column:
    """``up`` or ``down``; slopes inside the margin stay unlabelled."""
    value = as_column(slope)
    return F.when(value > margin, "up").when(value < -margin, "down")


def flag_over(col: Column | str, limit: float = OVERCOUNT_LIMIT) -> Column:
    return as_column(col) > F.lit(limit)


def risk_tier(score: Column | str) -> Column:
    """Support tier of a risk score: 1 from 40, 2 from 60, 3 from 80."""
    value = as_column(score)
    return F.when(value >= 80, 3).when(value >= 60, 2).when(value >= 40, 1)
