"""Grouped aggregates and filters. Rows whose key is NULL take no part."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from cohortwise.functions import aggregates as A


def names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which none of ``cols`` is missing."""
    return df.na.drop(subset=list(cols)) if cols else df


def grouped(df: DataFrame, keys: str | Sequence[str]) -> GroupedData:
    keys = names(keys)
    return known(df, keys).groupBy(*keys)


def rate_by(
    df: DataFrame, keys: str | Sequence[str], col: str, value: Any, out: str = "rate"
) -> DataFrame:
    """Percentage of each key's rows whose ``col`` equals ``value``."""
    return grouped(df, keys).agg(A.rate_of(col, value).alias(out))


def mean_by(
    df: DataFrame, keys: str | Sequence[str], col: str, out: str | None = None
) -> DataFrame:
    return grouped(df, keys).agg(F.avg(col).alias(out or col))


def count_by(
    df: DataFrame, keys: str | Sequence[str], out: str = "count", where: Column | None = None
) -> DataFrame:
    rows = df if where is None else df.where(where)
    return grouped(rows, keys).agg(F.count(F.lit(1)).alias(out))


def sum_by(
    df: DataFrame,
    keys: str | Sequence[str],
    col: str,
    out: str | None = None,
    where: Column | None = None,
) -> DataFrame:
    rows = df if where is None else df.where(where)
    return grouped(rows, keys).agg(A.total(col).alias(out or col))


def agg_by(df: DataFrame, keys: str | Sequence[str], **named: Column) -> DataFrame:
    return grouped(df, keys).agg(*[expr.alias(name) for name, expr in named.items()])


def scalars(df: DataFrame, **named: Column) -> DataFrame:
    """One row of whole-table aggregates."""
    return df.agg(*[expr.alias(name) for name, expr in named.items()])


def with_scalars(df: DataFrame, of: DataFrame, out: str, **named: Column) -> DataFrame:
    """Add whole-table aggregates of ``of`` to every row of ``df`` as one struct.

    The struct is a scalar subquery: evaluated once and handed to every task as
    a value, without a join. Read its fields as ``out.name``.
    """
    packed = of.agg(F.struct(*[expr.alias(name) for name, expr in named.items()]))
    return df.withColumn(out, packed.scalar())


def where_vs_mean(df: DataFrame, col: str, op: str = "<") -> DataFrame:
    """Rows whose ``col`` lies below (or above) the mean of ``col``."""
    mean = df.agg(F.avg(col)).scalar()
    if op not in ("<", ">"):
        raise ValueError("op must be '<' or '>'")
    return df.where(F.col(col) < mean if op == "<" else F.col(col) > mean)


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def frequency(df: DataFrame, key: str, out: str = "count") -> DataFrame:
    return count_by(df, key, out)


def top_values(df: DataFrame, col: str, k: int = 12, out: str = "count") -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller value."""
    return frequency(df, col, out).orderBy(F.desc(out), F.asc(col)).limit(k)


def share(df: DataFrame, key: str) -> DataFrame:
    """Count per key and its percentage of all counted rows."""
    counts = frequency(df, key)
    whole = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") * 100.0 / whole)


def arg_extreme(
    df: DataFrame, col: str, tiebreak: str, largest: bool = True, n: int = 1
) -> DataFrame:
    """The row(s) with the largest or smallest ``col``; missing values come last."""
    order = F.desc_nulls_last(col) if largest else F.asc_nulls_last(col)
    return df.orderBy(order, F.asc(tiebreak)).limit(n)


def first_last(df: DataFrame, key: str, order: Sequence[str], col: str) -> DataFrame:
    """First and last ``col`` per key along ``order``, and the change between them."""
    along = F.struct(*order)
    ends = agg_by(df, key, first=F.min_by(col, along), last=F.max_by(col, along))
    return ends.withColumn("change", F.col("last") - F.col("first"))
