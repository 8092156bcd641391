"""Platform overview: headline figures, risk flags, group health, simple breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import aggregates as A
from cohortwise.functions.periods import month_key, month_start
from cohortwise.functions.scalars import flag_below, gap_size, percent_text, vs_mean_flag
from cohortwise.operators.cleaning import enrich_students
from cohortwise.operators.features import student_metrics
from cohortwise.operators.grouping import (
    agg_by, count_by, restrict_to, scalars, top_values, where_vs_mean,
)
from cohortwise.operators.rollups import (
    attendance_days, attendance_rate, concept_months, result_rate,
)
from cohortwise.sources.tables import CohortTables

# Below either limit a student counts as at risk.
ATTENDANCE_LIMIT = 60.0
GRADE_LIMIT = 55.0


def student_risk(
    t: CohortTables, att_limit: float = ATTENDANCE_LIMIT, grade_limit: float = GRADE_LIMIT
) -> DataFrame:
    """Attendance rate, mean grade and risk flag of every student."""
    students = t.get("students", "student_id", "group_name", "course_name")
    measured = students.join(student_metrics(t, "att_rate", "avg_grade"), "student_id", "left")
    flag = flag_below({"att_rate": att_limit, "avg_grade": grade_limit})
    return measured.withColumn("is_at_risk", flag)


def concept_fail(t: CohortTables) -> DataFrame:
    return result_rate(concept_months(t, "concept_name"), ["concept_name"], "failed", "fail_rate")


def group_rates(t: CohortTables) -> DataFrame:
    """Attendance rate per group with the group's and course's names."""
    rates = attendance_rate(attendance_days(t, "group_id"), "att_rate", group_id=F.col("group_id"))
    named = t.get("groups", "group_id", "group_name", "course_id")
    courses = t.get("courses", "course_id", "course_name")
    return rates.join(named, "group_id", "left").join(courses, "course_id", "left")


def group_attendance(t: CohortTables) -> DataFrame:
    """Group rates with a flag for those below the mean of all group rates."""
    rates = group_rates(t)
    mean = rates.agg(F.avg("att_rate")).scalar()
    return rates.select(
        "group_id", "att_rate", "group_name", "course_id", "course_name",
        vs_mean_flag("att_rate", mean).alias("vs_mean"),
    )


def attendance_summary(t: CohortTables) -> DataFrame:
    """Mean group rate, lowest and highest group, and how many lie below the mean."""
    flagged = group_attendance(t)
    return scalars(
        flagged,
        platform_avg=F.avg("att_rate"),
        lowest_group=F.min_by("group_name", F.struct("att_rate", "group_id")),
        lowest_rate=F.min("att_rate"),
        highest_group=F.max_by("group_name", F.struct("att_rate", "group_id")),
        highest_rate=F.max("att_rate"),
        groups_below=F.count_if(F.col("vs_mean") == "below"),
    )


def low_attendance_groups(t: CohortTables) -> DataFrame:
    """Groups below the mean of group rates, lowest first."""
    return where_vs_mean(group_rates(t), "att_rate").orderBy("att_rate", "group_id")


def true_sizes(t: CohortTables, *columns: str) -> DataFrame:
    """Groups with the number of students actually enrolled, 0 for empty groups."""
    sizes = count_by(t.get("students", "group_id"), "group_id", "true_count")
    groups = t.get("groups", "group_id", "group_name", *columns)
    return groups.join(sizes, "group_id", "left").na.fill(0, subset=["true_count"])


def group_health(t: CohortTables) -> DataFrame:
    """Stated against true size of each group."""
    sized = true_sizes(t, "stated_num_students")
    gap = F.col("stated_num_students") - F.col("true_count")
    return sized.withColumns({"size_gap": gap, "size_gap_abs": gap_size(gap)})


def monthly_attendance(t: CohortTables) -> DataFrame:
    rates = attendance_rate(
        attendance_days(t, "day"), "attendance_rate", start=month_start("day")
    )
    return rates.select(month_key("start").alias("month"), "attendance_rate")


def group_month_attendance(t: CohortTables) -> DataFrame:
    """Attendance rate per month and known group."""
    rates = attendance_rate(
        attendance_days(t, "group_id", "day"), "rate",
        start=month_start("day"), group_id=F.col("group_id"),
    )
    return rates.join(t.get("groups", "group_id", "group_name"), "group_id").select(
        month_key("start").alias("month"), "group_id", "rate", "group_name"
    )


def grade_by_course(t: CohortTables) -> DataFrame:
    """Mean score per course name, lowest first."""
    graded = _graded_courses(t)
    return agg_by(
        graded, "course_name", avg_score=F.try_divide(F.sum("_sum"), F.sum("_n"))
    ).orderBy(F.asc_nulls_last("avg_score"), "course_name")


def _graded_courses(t: CohortTables) -> DataFrame:
    """Score sums per course id, then the names: the fact rows meet no join."""
    sums = agg_by(
        t.get("grades", "course_id", "score"), "course_id",
        _sum=F.sum("score"), _n=F.count("score"),
    )
    return sums.join(t.get("courses", "course_id", "course_name"), "course_id")


def risk_by_course(t: CohortTables) -> DataFrame:
    """Percentage of at-risk students per course."""
    return agg_by(student_risk(t), "course_name", risk_rate=A.share_true("is_at_risk")).orderBy(
        "risk_rate", "course_name"
    )


def top_cities(t: CohortTables, k: int = 12) -> DataFrame:
    return top_values(t.get("students", "city"), "city", k)


def students_by_group_course(t: CohortTables) -> DataFrame:
    named = t.get("students", "course_name", "group_name")
    return count_by(named, ["course_name", "group_name"], "students")


def attendance_and_grades(t: CohortTables) -> DataFrame:
    """Sums of attendance and scores: one row in all, one per student and one per group.

    ``kind`` is all, student or group and ``key`` the id as text. Attendance and grades are read
    once: their rows are summed per (group, student), and each of these few rows counts for its
    student, its group and the whole. ``listed`` marks students of the student list, with or without rows.
    """
    hit = F.when(F.col("status") == "attended", 1.0).otherwise(0.0).alias("hit")
    attendance = t.get("attendance", "student_id", "group_id", "status").select("student_id", "group_id", hit)
    grades = t.get("grades", "student_id", "score").select("student_id", F.col("score").cast("double").alias("score"))
    stacked = attendance.unionByName(grades, allowMissingColumns=True)
    pairs = stacked.groupBy("group_id", "student_id").agg(
        F.count("hit").alias("sessions"), F.sum("hit").alias("attended"),
        F.count("score").alias("scores"), F.sum("score").alias("points"),
    )
    numbers = ["sessions", "attended", "scores", "points"]

    def place(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))

    places = F.array(
        place("all", F.lit("")), place("student", F.col("student_id")), place("group", F.col("group_id"))
    )
    counted = pairs.select(F.explode(places).alias("at"), *numbers, F.lit(False).alias("listed"))
    students = t.get("students", "student_id").select(
        place("student", F.col("student_id")).alias("at"), F.lit(True).alias("listed")
    )
    every = counted.unionByName(students, allowMissingColumns=True)
    return (
        every.select("at.*", *numbers, "listed").na.drop(subset=["key"]).groupBy("kind", "key")
        .agg(*[F.sum(n).alias(n) for n in numbers], F.max("listed").alias("listed"))
        .withColumns(
            {
                "att_rate": F.try_divide(F.col("attended"), F.col("sessions")) * 100,
                "avg_grade": F.try_divide(F.col("points"), F.col("scores")),
            }
        )
    )


def risk_count(att_limit: float = ATTENDANCE_LIMIT, grade_limit: float = GRADE_LIMIT) -> Column:
    """How many listed students of :func:`attendance_and_grades` lie below either limit."""
    flag = flag_below({"att_rate": att_limit, "avg_grade": grade_limit})
    return F.count_if((F.col("kind") == "student") & F.col("listed") & flag)


def platform_kpis(t: CohortTables) -> DataFrame:
    """Headline figures: row-weighted, per-student and per-group averages side by side."""
    summed = attendance_and_grades(t)

    def mean(kind: str, rate: str) -> Column:
        return F.avg(F.when(F.col("kind") == kind, F.col(rate)))

    rows = F.count(F.lit(1))
    found = scalars(
        summed,
        students=F.count_if((F.col("kind") == "student") & F.col("listed")),
        attendance_pct=mean("all", "att_rate"),
        grade_mean=mean("all", "avg_grade"),
        mean_student_attendance=mean("student", "att_rate"),
        mean_student_grade=mean("student", "avg_grade"),
        mean_group_attendance=mean("group", "att_rate"),
        at_risk=risk_count(),
    )
    return found.select(
        "students",
        t.get("groups", "group_id").agg(rows).scalar().alias("groups"),
        t.get("courses", "course_id").agg(rows).scalar().alias("courses"),
        "attendance_pct", "grade_mean", "mean_student_attendance", "mean_student_grade",
        "mean_group_attendance", "at_risk",
        F.try_divide(F.col("at_risk") * 100.0, F.col("students")).alias("at_risk_pct"),
    )


def oversized_groups(t: CohortTables, cap: int = 45) -> DataFrame:
    """Groups with more than ``cap`` students enrolled, largest first."""
    sizes = true_sizes(t).where(F.col("true_count") > cap)
    return sizes.orderBy(F.desc("true_count"), "group_id")


def course_modules(t: CohortTables) -> DataFrame:
    """One row per module of each course, numbered from 1; unreadable lists have none."""
    listed = F.from_json("modules", "array<string>")
    return t.get("courses", "course_id", "modules").select(
        "course_id", F.posexplode(listed).alias("number", "module")
    ).select("course_id", (F.col("number") + 1).alias("number"), "module")


def enriched_students(t: CohortTables) -> DataFrame:
    """Students with their group's name, course and instructor, joined here."""
    plain = t.get("students", "student_id", "full_name", "group_id")
    return enrich_students(plain, t.get("groups"), t.get("courses", "course_id", "course_name"))


def students_of_low_groups(t: CohortTables) -> DataFrame:
    """Students whose group lies below the mean of group rates."""
    students = t.get("students", "student_id", "full_name", "group_id")
    return restrict_to(students, low_attendance_groups(t), "group_id")


def group_rate_texts(t: CohortTables) -> DataFrame:
    """Group attendance rates as texts with one digit and a percent sign."""
    return group_rates(t).select("group_id", percent_text(F.round("att_rate", 6)).alias("att_rate"))
