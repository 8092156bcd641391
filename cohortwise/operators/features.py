"""One row per student: the measures every report builds on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.grouping import grouped
from cohortwise.sources.tables import CohortTables

FEATURES = ["att_rate", "avg_grade", "logins", "video_sec", "failed_c"]


def _parts(t: CohortTables, wanted: set[str]) -> list[DataFrame]:
    """Narrow per-fact inputs sharing the column ``student_id``."""
    parts = []
    if "att_rate" in wanted:
        hit = F.when(F.col("status") == "attended", 1.0).otherwise(0.0).alias("hit")
        parts.append(t.get("attendance", "student_id", "status").select("student_id", hit))
    if "avg_grade" in wanted:
        grades = t.get("grades", "student_id", "score")
        parts.append(grades.withColumn("graded", F.lit(1)))
    events = {"logins": "login", "video_sec": "video_watch"}
    kinds = [kind for name, kind in events.items() if name in wanted]
    if kinds:
        columns = ["student_id", "event_type"]
        if "video_sec" in wanted:
            columns.append("duration_seconds")
        used = t.get("engagement", *columns).where(F.col("event_type").isin(kinds))
        parts.append(used)
    if "failed_c" in wanted:
        failed = t.get("concepts", "student_id", "mastery_status").where(
            F.col("mastery_status") == "failed"
        )
        parts.append(failed.select("student_id", F.lit(1).alias("failed")))
    return parts


def _measures() -> dict[str, Column]:
    login = F.count(F.when(F.col("event_type") == "login", 1))
    watch = F.col("event_type") == "video_watch"
    watched = F.coalesce(F.sum(F.when(watch, F.col("duration_seconds"))), F.lit(0.0))
    return {
        "att_rate": F.avg("hit") * 100,
        "avg_grade": F.avg("score"),
        "logins": F.nullif(login, F.lit(0)),
        "video_sec": F.when(F.count(F.when(watch, 1)) > 0, watched),
        "failed_c": F.nullif(F.count("failed"), F.lit(0)),
    }


# Rows behind the two measures that can be required.
_PRESENCE = {"att_rate": "att_rows", "avg_grade": "grade_rows"}


def _measured(t: CohortTables, wanted: Sequence[str], required: Sequence[str]) -> DataFrame:
    parts = _parts(t, {*wanted, *required})
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = {"att_rate": F.count("hit"), "avg_grade": F.count("graded")}
    measures = _measures()
    return grouped(stacked, "student_id").agg(
        *[measures[name].alias(name) for name in wanted],
        *[rows[name].alias(_PRESENCE[name]) for name in required],
    )


def student_metrics(
    t: CohortTables, *wanted: str, required: Sequence[str] = ()
) -> DataFrame:
    """The chosen measures per student; NULL where a student has no such rows.

    All facts are stacked and aggregated together: one shuffle on the student
    key, with partial sums built before it, in place of a full outer join per
    fact. ``required`` keeps only students with attendance (``att_rate``)
    and/or grade rows (``avg_grade``). A stored ``student_metrics`` table
    (see :func:`all_metrics`) is used when there is one.
    """
    if t.has("student_metrics"):
        result = t.get("student_metrics")
    else:
        result = _measured(t, wanted, required)
    for name in required:
        result = result.where(F.col(_PRESENCE[name]) > 0)
    return result.select("student_id", *wanted)


def all_metrics(t: CohortTables) -> DataFrame:
    """Every measure with its row counts, for storing and sharing between reports."""
    return _measured(t, FEATURES, list(_PRESENCE))


def student_features(t: CohortTables) -> DataFrame:
    """All five measures, 0 where a student has none."""
    return student_metrics(t, *FEATURES).na.fill(0, subset=FEATURES)
