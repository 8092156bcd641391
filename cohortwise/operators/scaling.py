"""Whole-table scaling; the statistics enter as scalar subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.grouping import with_scalars


def unit_scaled(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between two ends, 0 when the ends meet."""
    reach = high - low
    return F.when(reach > 0, (value - low) / reach).otherwise(0.0)


def min_max_norm(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    ends = {f"{c}_lo": F.min(c) for c in cols} | {f"{c}_hi": F.max(c) for c in cols}
    scaled = {
        c: unit_scaled(F.col(c), F.col(f"_ends.{c}_lo"), F.col(f"_ends.{c}_hi")) for c in cols
    }
    return with_scalars(df, df, "_ends", **ends).withColumns(scaled).drop("_ends")


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and divide by the population deviation; a constant column becomes 0."""
    parts = {f"{c}_mean": F.avg(c) for c in cols} | {f"{c}_sd": F.stddev_pop(c) for c in cols}

    def scaled(c: str) -> Column:
        z = F.try_divide(F.col(c) - F.col(f"_parts.{c}_mean"), F.col(f"_parts.{c}_sd"))
        return F.when(F.col(c).isNotNull(), F.coalesce(z, F.lit(0.0)))

    found = with_scalars(df, df, "_parts", **parts)
    return found.withColumns({c: scaled(c) for c in cols}).drop("_parts")
