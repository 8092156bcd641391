"""Attendance and engagement over time, concepts, age bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions import bands as B
from cohortwise.functions.periods import (
    month_key, name_of_day, name_of_month, week_key, week_start,
)
from cohortwise.functions.scalars import map_values
from cohortwise.operators.features import student_metrics
from cohortwise.operators.grouping import (
    agg_by, arg_extreme, count_by, scalars, share, with_scalars,
)
from cohortwise.operators.reshape import cells_long, pivot_days, pivot_rate
from cohortwise.operators.rollups import (
    attendance_days, attendance_rate, concept_months, result_rate,
)
from cohortwise.plans.overview import concept_fail
from cohortwise.sources.tables import CohortTables

# Event types and their display names.
EVENT_LABELS = {
    "login": "Login",
    "video_watch": "Video Watch",
    "resource_download": "Resource Download",
    "quiz_attempt": "Quiz Attempt",
    "forum_post": "Forum Post",
}


def event_share(t: CohortTables) -> DataFrame:
    """Count and share of every event type."""
    return share(t.get("engagement", "event_type"), "event_type")


def event_share_labelled(t: CohortTables) -> DataFrame:
    """The same for the known event types, under their display names."""
    events = t.get("engagement", "event_type")
    return share(events.select(map_values("event_type", EVENT_LABELS).alias("event")), "event")


# --- concepts -----------------------------------------------------------------------------


def _concept_course_rates(t: CohortTables) -> DataFrame:
    keys = ["concept_name", "course_id"]
    return result_rate(concept_months(t, *keys), keys, "failed", "fail_rate")


def concept_fail_by_course(t: CohortTables) -> DataFrame:
    """Failure rate per concept and course, highest first."""
    courses = t.get("courses", "course_id", "course_name")
    return _concept_course_rates(t).join(courses, "course_id", "left").orderBy(
        F.desc("fail_rate"), "concept_name", "course_id"
    )


def top_failing_concepts(t: CohortTables, k: int = 15) -> DataFrame:
    return concept_fail_by_course(t).limit(k)


def biggest_weak_spot(t: CohortTables) -> DataFrame:
    """The concept and course with the highest failure rate."""
    return concept_fail_by_course(t).limit(1).select("concept_name", "course_name", "fail_rate")


def course_concept_grid(t: CohortTables, concepts: Sequence[str] = ()) -> DataFrame:
    """Failure rate of every concept met in a course; 0 for listed concepts never met."""
    courses = t.get("courses", "course_id", "course_name")
    named = _concept_course_rates(t).join(courses, "course_id")
    return cells_long(named, "course_name", "concept_name", "fail_rate", concepts)


def course_concept_pivot(t: CohortTables, concepts: list[str]) -> DataFrame:
    """The grid as one column per listed concept; any other concept raises an error."""
    courses = t.get("courses", "course_id", "course_name")
    named = _concept_course_rates(t).join(courses, "course_id")
    return pivot_rate(named, "course_name", "concept_name", "fail_rate", concepts)


def worst_concept(t: CohortTables) -> DataFrame:
    return arg_extreme(concept_fail(t), "fail_rate", "concept_name").select(
        F.col("concept_name").alias("worst_concept")
    )


def worst_concept_trend(t: CohortTables) -> DataFrame:
    """Monthly pass rate and attempts of the concept failed most.

    One pass over the results: each concept's months, as many as the calendar has, are
    gathered beside its failure rate, and the worst concept's are laid out again.
    """
    months = concept_months(t, "concept_name", "start").na.drop(subset=["concept_name"])
    month = F.struct("start", "passed", "results", "known")
    concepts = months.groupBy("concept_name").agg(
        (F.sum("failed") / F.sum("results") * 100).alias("fail_rate"),
        F.collect_list(month).alias("months"),
    )
    own = arg_extreme(concepts, "fail_rate", "concept_name").select(F.inline("months"))
    return own.na.drop(subset=["start"]).select(
        month_key("start").alias("month"),
        (F.col("passed") / F.col("results") * 100).alias("pass_rate"),
        F.col("known").alias("attempts"),
    )


def worst_concept_change(t: CohortTables) -> DataFrame:
    """Pass rate in the first and last month, the change, and a word for it."""
    ends = scalars(
        worst_concept_trend(t),
        first_rate=F.min_by("pass_rate", "month"),
        last_rate=F.max_by("pass_rate", "month"),
    )
    change = F.col("last_rate") - F.col("first_rate")
    return ends.withColumn("change", change).withColumn("trend", B.trend_word("change"))


# --- calendar -----------------------------------------------------------------------------


def weekly_timeline(t: CohortTables, trim_edges: bool = False) -> DataFrame:
    """Attendance rate and event count per week.

    ``trim_edges`` drops the first and last week, which are usually partial.
    """
    rates = attendance_rate(attendance_days(t, "day"), "att_rate", start=week_start("day"))
    events = t.get("engagement", "event_datetime").select(
        week_start("event_datetime").alias("start")
    )
    weeks = rates.join(count_by(events, "start", "events"), "start", "full")
    if trim_edges:
        ends = with_scalars(weeks, weeks, "_ends", first=F.min("start"), last=F.max("start"))
        weeks = ends.where(
            (F.col("start") > F.col("_ends.first")) & (F.col("start") < F.col("_ends.last"))
        )
    return weeks.select(week_key("start").alias("week"), "att_rate", "events")


def weekly_timeline_trimmed(t: CohortTables) -> DataFrame:
    return weekly_timeline(t, trim_edges=True)


def dip_week(t: CohortTables) -> DataFrame:
    """The full week with the lowest attendance."""
    weeks = weekly_timeline(t, trim_edges=True).na.drop(subset=["att_rate"])
    return arg_extreme(weeks, "att_rate", "week", largest=False).select("week", "att_rate")


def cumulative_attendance(t: CohortTables, limit: float = 60.0) -> DataFrame:
    """Attendance rate of each student up to the end of each week, and whether it is below ``limit``."""
    rows = t.get("attendance", "student_id", "status", "session_datetime")
    weeks = agg_by(
        rows.select("student_id", "status", week_start("session_datetime").alias("start")),
        ["student_id", "start"],
        sessions=F.count(F.lit(1)), attended=F.count_if(F.col("status") == "attended"),
    )
    # A student has at most as many rows here as the calendar has weeks.
    so_far = Window.partitionBy("student_id").orderBy("start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rate = F.sum("attended").over(so_far) / F.sum("sessions").over(so_far) * 100
    running = weeks.withColumn("att_rate", rate)
    return running.select(
        "student_id", week_key("start").alias("week"), "att_rate",
        (F.col("att_rate") < limit).alias("below"),
    )


def month_dow_heatmap(t: CohortTables) -> DataFrame:
    """Attendance rate per month name and day name."""
    rates = attendance_rate(
        attendance_days(t, "day"), "rate", m=F.month("day"), d=F.weekday("day")
    )
    return rates.select(name_of_month("m").alias("month"), name_of_day("d").alias("dow"), "rate")


def month_dow_grid(t: CohortTables) -> DataFrame:
    """The same with one column per day, Saturday to Friday."""
    return pivot_days(month_dow_heatmap(t))


# --- age ----------------------------------------------------------------------------------


def age_band_stats(t: CohortTables) -> DataFrame:
    """Mean grade, attendance and logins per age band; logins over users only."""
    measures = student_metrics(t, "avg_grade", "att_rate", "logins")
    aged = (
        t.get("students", "student_id", "age")
        .na.drop(subset=["age"])
        .join(measures, "student_id", "left")
        .withColumn("band_ord", B.age_order("age"))
        .withColumn("age_band", B.band_label("band_ord", B.AGE_LABELS))
    )
    return agg_by(
        aged, ["band_ord", "age_band"],
        avg_grade=F.avg("avg_grade"), att_rate=F.avg("att_rate"),
        logins=F.avg("logins"), count=F.count("student_id"),
    )


def age_band_leaders(t: CohortTables) -> DataFrame:
    """Best age band by grade, by logins and by attendance; of equal ones the oldest."""

    def leader(measure: str) -> Column:
        order = F.when(F.col(measure).isNotNull(), F.struct(measure, "band_ord"))
        return F.max_by("age_band", order)

    return scalars(
        age_band_stats(t),
        best_grade_band=leader("avg_grade"),
        best_grade=F.max("avg_grade"),
        most_engaged_band=leader("logins"),
        best_attendance_band=leader("att_rate"),
    )
