"""Shared expressions for tables of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """False for null vectors and vectors with null, NaN or infinite components."""
    one = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, one), F.lit(False))


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))
