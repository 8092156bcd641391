"""Correlation and straight-line fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import aggregates as A
from cohortwise.operators.grouping import agg_by


def ols_by(df: DataFrame, keys: str | Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per key."""
    return agg_by(
        df, keys,
        n=A.pair_count(y, x), slope=A.slope(y, x),
        intercept=A.intercept(y, x), r2=A.r_squared(y, x),
    )


def linreg_by(
    df: DataFrame, keys: str | Sequence[str], x: str, y: str, min_points: int = 3
) -> DataFrame:
    """Slope and r per key with enough points; r is 0 where ``y`` never moves."""
    fits = agg_by(df, keys, points=A.pair_count(y, x), slope=A.slope(y, x), r=A.pearson(x, y))
    return fits.where(F.col("points") >= min_points).na.fill(0.0, subset=["r"])


def line_from_sums(
    n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column,
    x_moves: Column, y_moves: Column,
) -> dict[str, Column]:
    """Slope, intercept and r2 from weighted power sums.

    ``x_moves`` and ``y_moves`` say whether the side takes more than one value: the
    difference of two sums need not be exactly zero when it does not.
    """
    vx = F.when(x_moves, sxx - sx * sx / n).otherwise(0.0)
    vy = F.when(y_moves, syy - sy * sy / n).otherwise(0.0)
    cov = F.when(x_moves & y_moves, sxy - sx * sy / n).otherwise(0.0)
    slope = F.try_divide(cov, vx)
    return {
        "n": n,
        "slope": slope,
        "intercept": (sy - slope * sx) / n,
        "r2": F.when(vx > 0, F.coalesce(F.try_divide(cov * cov, vx * vy), F.lit(1.0))),
    }
