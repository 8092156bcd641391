"""Pivots and dense grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.periods import DAYS


def pivot_rate(
    df: DataFrame, row: str, col: str, val: str, values: Sequence[str], fill: float | None = 0.0
) -> DataFrame:
    """One column per listed value of ``col`` holding the mean of ``val``.

    A value that is not listed raises an error, so that nothing is left out unseen.
    """
    listed = F.col(col).isNull() | F.col(col).isin(list(values))
    unlisted = F.raise_error(F.concat(F.lit(f"{col} without a column: "), F.col(col).cast("string")))
    df = df.withColumn(col, F.when(listed, F.col(col)).otherwise(unlisted.cast("string")))
    wide = df.na.drop(subset=[row]).groupBy(row).pivot(col, list(values)).agg(F.avg(val))
    return wide if fill is None else wide.na.fill(fill, subset=list(values))


def pivot_days(df: DataFrame, row: str = "month", col: str = "dow", val: str = "rate") -> DataFrame:
    """Days of the week as columns, Saturday first; missing cells stay missing."""
    return pivot_rate(df, row, col, val, DAYS, fill=None)


def cells_long(
    df: DataFrame, row: str, col: str, val: str, columns: Sequence[str] = (), fill: float = 0.0
) -> DataFrame:
    """Mean ``val`` of each row label with each column label, in long form.

    Only cells that occur are returned, and for every row label the listed
    ``columns`` it never met, with ``fill``.
    """
    cells = df.na.drop(subset=[row, col]).groupBy(row, col).agg(F.avg(val).alias(val))
    if not columns:
        return cells
    listed = F.array(*[F.lit(c) for c in columns])
    met = cells.groupBy(row).agg(F.collect_set(F.when(F.col(col).isin(list(columns)), F.col(col))).alias("_met"))
    missing = met.select(row, F.explode(F.array_except(listed, "_met")).alias(col), F.lit(fill).alias(val))
    return cells.unionByName(missing)
