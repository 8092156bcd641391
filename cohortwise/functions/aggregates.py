"""Aggregate expressions used inside ``groupBy(...).agg(...)``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise.functions.scalars import as_column


def rate_of(col: Column | str, value: Any) -> Column:
    """Percentage of rows equal to ``value``; NULL rows stay in the denominator."""
    return F.avg(F.when(as_column(col) == F.lit(value), 1.0).otherwise(0.0)) * 100


def total(col: Column | str) -> Column:
    """Sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(as_column(col)), F.lit(0.0))


def mean_if(col: Column | str, flag: Column) -> Column:
    return F.avg(F.when(flag, as_column(col)))


def share_true(flag: Column | str) -> Column:
    """Percentage of true among known flags; unknown flags are skipped."""
    return F.avg(as_column(flag).cast("double")) * 100


def _both(value: Column, other: Column) -> Column:
    return F.when(other.isNotNull(), value)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson r over pairs with both sides known; NULL when a side is constant."""
    a, b = as_column(x).cast("double"), as_column(y).cast("double")
    spread = F.stddev_samp(_both(a, b)) * F.stddev_samp(_both(b, a))
    return F.try_divide(F.covar_samp(a, b), spread)


def slope(y: Column | str, x: Column | str) -> Column:
    return F.regr_slope(as_column(y).cast("double"), as_column(x).cast("double"))


def intercept(y: Column | str, x: Column | str) -> Column:
    return F.regr_intercept(as_column(y).cast("double"), as_column(x).cast("double"))


def r_squared(y: Column | str, x: Column | str) -> Column:
    return F.regr_r2(as_column(y).cast("double"), as_column(x).cast("double"))


def pair_count(y: Column | str, x: Column | str) -> Column:
    return F.regr_count(as_column(y).cast("double"), as_column(x).cast("double"))
