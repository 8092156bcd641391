"""Groups and students: size audit, merge candidates, segments, risk ranking, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import aggregates as A
from cohortwise.functions import bands as B
from cohortwise.functions.scalars import pct_of
from cohortwise.operators import risk as R
from cohortwise.operators.features import FEATURES, student_features, student_metrics
from cohortwise.operators.grouping import arg_extreme, scalars
from cohortwise.operators.scaling import zscore
from cohortwise.operators.segmentation import cluster_students, label_clusters
from cohortwise.operators.segmentation import segment_profile as profile_of
from cohortwise.operators.similarity import concept_profiles
from cohortwise.operators.similarity import profile_similarity as similar
from cohortwise.plans.overview import (
    attendance_and_grades, concept_fail, risk_count, true_sizes,
)
from cohortwise.sources.tables import CohortTables

# Fixed value: groups of this size and below are not merge candidates.
VIABLE_SIZE = 10


# --- size audit ---------------------------------------------------------------------------


def stated_vs_true(t: CohortTables) -> DataFrame:
    """Stated against true group size, smallest true size first."""
    sized = true_sizes(t, "course_id", "stated_num_students").na.fill(
        0, subset=["stated_num_students"]
    )
    gap = F.col("stated_num_students") - F.col("true_count")
    return (
        sized.join(t.get("courses", "course_id", "course_name"), "course_id", "left")
        .withColumn("discrepancy", gap)
        .withColumn("disc_pct", pct_of("discrepancy", "stated_num_students"))
        .orderBy("true_count", "group_id")
    )


def overcounted_groups(t: CohortTables, limit: float = B.OVERCOUNT_LIMIT) -> DataFrame:
    """Groups whose stated size exceeds the true one by more than ``limit`` percent."""
    return stated_vs_true(t).where(B.flag_over("disc_pct", limit))


def size_audit_totals(t: CohortTables) -> DataFrame:
    audit = stated_vs_true(t)
    return scalars(
        audit,
        smallest_group=F.min_by("group_name", F.struct("true_count", "group_id")),
        smallest_size=F.min("true_count"),
        max_discrepancy=F.max("discrepancy"),
        total_discrepancy=F.sum("discrepancy"),
    )


# --- merge candidates ---------------------------------------------------------------------


def group_sizes(t: CohortTables) -> DataFrame:
    courses = t.get("courses", "course_id", "course_name")
    return true_sizes(t, "course_id").join(courses, "course_id", "left")


def merge_candidates(t: CohortTables, exclude_self: bool = False) -> DataFrame:
    """Concept likeness of every viable group to the smallest one, most alike first."""
    sizes = group_sizes(t)
    smallest = sizes.agg(F.min_by("group_id", F.struct("true_count", "group_id"))).scalar()
    profiles = concept_profiles(
        t.get("concepts", "student_id", "concept_name", "score_pct"),
        t.get("students", "student_id", "group_id"),
    )
    alike = similar(profiles, smallest, exclude_self=exclude_self)
    return (
        sizes.where(F.col("true_count") > VIABLE_SIZE)
        .join(alike, "group_id")
        .select("group_id", "group_name", "course_name", "true_count", "similarity")
        .orderBy(F.desc_nulls_last("similarity"), "group_id")
    )


def top_merge_candidates(t: CohortTables, k: int = 8) -> DataFrame:
    return merge_candidates(t).limit(k)


# --- segments -----------------------------------------------------------------------------


def features(t: CohortTables) -> DataFrame:
    return student_features(t)


def scaled_features(t: CohortTables) -> DataFrame:
    """The five measures as z-scores."""
    return zscore(student_features(t), FEATURES)


def student_segments(t: CohortTables, k: int = 4, seed: int = 42, n_init: int = 10) -> DataFrame:
    """Students with their five measures, cluster and segment."""
    clustered = cluster_students(student_features(t), FEATURES, k, seed, n_init)
    return label_clusters(clustered).select("student_id", *FEATURES, "cluster", "segment")


def segment_profile(t: CohortTables) -> DataFrame:
    return profile_of(student_segments(t))


def course_labels(t: CohortTables) -> DataFrame:
    """The segment rules applied to courses in place of clusters."""
    course = t.get("students", "student_id", "course_id").withColumnRenamed("course_id", "cluster")
    labelled = label_clusters(student_features(t).join(course, "student_id"))
    return labelled.groupBy("cluster", "segment").agg(F.count(F.lit(1)).alias("students"))


# --- risk ---------------------------------------------------------------------------------


def activity_decline(t: CohortTables, grain: str = "month") -> DataFrame:
    """Fall in events per active period from the first to the second half, per student."""
    events = t.get("engagement", "student_id", "event_datetime")
    return R.activity_decline(events, "event_datetime", grain)


def risk_ranking(t: CohortTables, grain: str = "month") -> DataFrame:
    """Every student's four risk measures and weighted score."""
    measures = student_metrics(t, "att_rate", "avg_grade", "failed_c")
    decline = activity_decline(t, grain).select("student_id", "eng_decline")

    def gathered(students: DataFrame) -> DataFrame:
        return (
            students.join(measures, "student_id", "left")
            .join(decline, "student_id", "left")
            .na.fill(0, subset=["att_rate", "avg_grade", "failed_c", "eng_decline"])
        )

    named = t.get("students", "student_id", "full_name", "course_name", "group_name")
    return R.risk_score(gathered(named), of=gathered(t.get("students", "student_id")))


def top_at_risk(t: CohortTables, grain: str = "month", k: int = 10) -> DataFrame:
    return arg_extreme(risk_ranking(t, grain), "risk_score", "student_id", n=k)


def risk_tiers(t: CohortTables, grain: str = "month") -> DataFrame:
    """Students per support tier; scores below the first tier are left out."""
    tiered = risk_ranking(t, grain).select(B.risk_tier("risk_score").alias("tier"))
    return tiered.where("tier is not null").groupBy("tier").agg(F.count(F.lit(1)).alias("students"))


# --- decisions ----------------------------------------------------------------------------


def decision_inputs(t: CohortTables) -> DataFrame:
    """The figures behind the suggested decisions, in one row."""
    # The column names, which readers of the stored table expect.
    worst = arg_extreme(concept_fail(t), "fail_rate", "concept_name")
    worst = worst.select(F.struct("concept_name", "fail_rate")).scalar()
    smallest = F.min_by(F.struct("group_name", "true_count"), F.struct("true_count", "group_id"))
    smallest = true_sizes(t).agg(smallest).scalar()
    late = t.get("submissions", "is_late").agg(A.share_true("is_late")).scalar()
    groups = t.get("groups", "group_id", "group_name").select(
        F.lit("group").alias("kind"), F.col("group_id").cast("string").alias("key"), "group_id", "group_name"
    )
    # Attendance and grades are read once for the group rates and the students at risk.
    summed = attendance_and_grades(t).join(groups, ["kind", "key"], "left")
    group_rate = F.when(F.col("kind") == "group", F.col("att_rate"))
    order = F.when(group_rate.isNotNull(), F.struct("att_rate", "group_id"))
    rates = scalars(
        summed,
        rates=F.struct(
            F.min_by("group_name", order).alias("group_name"),
            F.min(group_rate).alias("low"), F.avg(group_rate).alias("mean"),
        ),
        risk_student_count=risk_count(),
    )
    return rates.select(
        worst["concept_name"].alias("worst_concept"),
        worst["fail_rate"].alias("worst_concept_fail_pct"),
        smallest["group_name"].alias("unviable_group_name"),
        smallest["true_count"].alias("unviable_group_size"),
        F.col("rates.group_name").alias("lowest_att_group_name"),
        F.col("rates.low").alias("lowest_att_group_rate"),
        F.col("rates.mean").alias("platform_avg_att"),
        "risk_student_count",
        late.alias("late_rate_pct"),
    )


def decisions(t: CohortTables) -> DataFrame:
    """Five suggested decisions with trigger, owner, timeframe and priority."""

    def pct(name: str) -> Column:
        return F.format_string("%.1f%%", F.col(name))

    def row(decision: Column, trigger: Column, owner: str, timeframe: str, priority: str) -> Column:
        return F.struct(
            decision.alias("decision"),
            trigger.alias("insight_trigger"),
            F.lit(owner).alias("owner"),
            F.lit(timeframe).alias("timeframe"),
            F.lit(priority).alias("priority"),
        )

    # Wording, owners, timeframes and priorities.
    rows = F.array(
        row(
            F.format_string("Redesign %s concept module", "worst_concept"),
            F.concat(F.lit("Highest concept failure rate: "), pct("worst_concept_fail_pct")),
            "Curriculum lead", "2 weeks", "Critical",
        ),
        row(
            F.format_string("Merge or dissolve %s", "unviable_group_name"),
            F.format_string("True group size is %d", "unviable_group_size"),
            "Operations lead", "This week", "Critical",
        ),
        row(
            F.format_string("Launch attendance intervention for %s", "lowest_att_group_name"),
            F.concat(F.lit("Lowest attendance group at "), pct("lowest_att_group_rate")),
            "Instructor manager", "This week", "High",
        ),
        row(
            F.lit("Start at-risk student outreach"),
            F.format_string(
                "%d students below attendance or grade thresholds", "risk_student_count"
            ),
            "Student success", "48 hours", "Critical",
        ),
        row(
            F.lit("Deploy late-submission reminders"),
            F.concat(F.lit("Late submission rate is "), pct("late_rate_pct")),
            "Academic operations", "1 week", "High",
        ),
    )
    return decision_inputs(t).select(F.inline(rows))
