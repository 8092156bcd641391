"""Small rollups of the two largest facts, from which most calendar, group and
concept reports follow without another pass over the rows.

A report asks for the dimensions it needs. With a stored rollup the figures come
from it; otherwise the fact is aggregated on exactly those dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.periods import month_start
from cohortwise.operators.grouping import grouped
from cohortwise.sources.tables import CohortTables


def _summed(df: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in counts.items()])


def _equals(col: str, value: str) -> Column:
    return F.when(F.col(col) == value, 1).otherwise(0)


def attendance_days(t: CohortTables, *dims: str) -> DataFrame:
    """Sessions and attended sessions per ``dims``, out of ``group_id`` and ``day``."""
    if t.has("attendance_days"):
        counts = {"sessions": F.col("sessions"), "attended": F.col("attended")}
        return _summed(t.get("attendance_days"), list(dims), counts)
    source = {"group_id": "group_id", "day": "session_datetime"}
    rows = t.get("attendance", *[source[d] for d in dims], "status")
    if "day" in dims:
        rows = rows.withColumn("day", F.to_date("session_datetime"))
    counts = {"sessions": F.lit(1), "attended": _equals("status", "attended")}
    return _summed(rows, list(dims), counts)


def attendance_rate(days: DataFrame, out: str, **keys: Column) -> DataFrame:
    """Percentage attended per key, from :func:`attendance_days`."""
    keyed = days.select(*[k.alias(n) for n, k in keys.items()], "sessions", "attended")
    rate = F.sum("attended") / F.sum("sessions") * 100
    return grouped(keyed, list(keys)).agg(rate.alias(out))


def concept_months(t: CohortTables, *dims: str) -> DataFrame:
    """Results per ``dims``, out of ``concept_name``, ``course_id`` and ``start`` (month).

    ``results`` counts rows, ``known`` those with a status, ``failed`` and
    ``passed`` those with that status.
    """
    names = ["results", "known", "failed", "passed"]
    if t.has("concept_months"):
        return _summed(t.get("concept_months"), list(dims), {n: F.col(n) for n in names})
    source = {"concept_name": "concept_name", "course_id": "course_id", "start": "timestamp"}
    rows = t.get("concepts", *[source[d] for d in dims], "mastery_status")
    if "start" in dims:
        rows = rows.withColumn("start", month_start("timestamp"))
    known = F.when(F.col("mastery_status").isNotNull(), 1).otherwise(0)
    counts = [F.lit(1), known, _equals("mastery_status", "failed"), _equals("mastery_status", "passed")]
    return _summed(rows, list(dims), dict(zip(names, counts, strict=True)))


def result_rate(months: DataFrame, keys: list[str], which: str, out: str) -> DataFrame:
    """Percentage of results failed or passed per key, from :func:`concept_months`."""
    return grouped(months, keys).agg((F.sum(which) / F.sum("results") * 100).alias(out))
