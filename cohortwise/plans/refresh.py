"""One run that stores the raw tables and every result table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from cohortwise.plans import activity, cohorts, overview, scores
from cohortwise.plans.shared import SHARED
from cohortwise.sources.files import load_table
from cohortwise.sources.sinks import materialize
from cohortwise.sources.tables import TABLES, CohortTables


def stored(spark: SparkSession, root: str, prefix: str = "raw_") -> CohortTables:
    return CohortTables.from_frames(
        {name: load_table(spark, root, f"{prefix}{name}") for name in TABLES}
    )


def refresh_all(
    spark: SparkSession,
    tables: CohortTables,
    root: str,
    event_grain: str = "month",
    date_grain: str | None = None,
    parallelism: int = 4,
) -> dict[str, bool]:
    """Write the raw tables, then every result table from them.

    Results read the stored raw tables, so cleaning and joins run once. The
    student measures, the attendance and concept rollups and the grade trend
    feed many results: they are stored first and read back. Returns which
    tables were replaced.
    """
    done: dict[str, bool] = {}

    def put(name: str, df: DataFrame) -> None:
        done[name] = materialize(df, root, name)

    for name in TABLES:
        materialize(tables.get(name), root, f"raw_{name}", skip_empty=False)
        done[f"raw_{name}"] = True
    raw = stored(spark, root)
    t = raw
    for name, build in SHARED.items():
        materialize(build(raw), root, f"shared_{name}", skip_empty=False)
        t = t.with_table(name, load_table(spark, root, f"shared_{name}"))

    results = {
        "agg_student_risk": overview.student_risk,
        "agg_concept_fail": overview.concept_fail,
        "agg_group_att": overview.group_rates,
        "agg_group_health": overview.group_health,
        "agg_monthly_att": overview.monthly_attendance,
        "agg_grade_course": overview.grade_by_course,
        "agg_kmeans_segments": cohorts.student_segments,
        "agg_suggestions": cohorts.decision_inputs,
        "agg_suggestions_low_att": overview.low_attendance_groups,
        "agg_q_q1_grp_att": overview.group_attendance,
        "agg_q_q1_monthly": overview.group_month_attendance,
        "agg_q_q2_stats": scores.score_by_type,
        "agg_q_q3_cstats": scores.score_by_course,
        "agg_q_q4_df": scores.attendance_vs_grade,
        "agg_q_q4_qdf": scores.quartile_grade,
        "agg_q_q5_df": scores.engagement_vs_grade,
        "agg_q_q5_eng_counts": activity.event_share,
        "agg_q_q6_fail": activity.concept_fail_by_course,
        "agg_q_q6_pivot_long": activity.course_concept_grid,
        "agg_q_q7_trend": activity.worst_concept_trend,
        "agg_q_q7_worst_name": activity.worst_concept,
        "agg_q_q8_sub": scores.submission_timing,
        "agg_q_q8_band_avg": scores.timing_band_score,
        "agg_q_q9_merged": activity.weekly_timeline,
        "agg_q_q9_heat": activity.month_dow_heatmap,
        "agg_q_q10_band_stats": activity.age_band_stats,
        "agg_q_q12_comp": cohorts.stated_vs_true,
        "agg_q_q13_grp": cohorts.group_sizes,
        "agg_q_q13_sim": cohorts.merge_candidates,
        "agg_q_q14_df": lambda tables: cohorts.risk_ranking(tables, event_grain),
        "agg_q_q15_trend": lambda tables: scores.grade_trend(tables, date_grain),
    }
    # Independent jobs: a few at a time keep the executors busy between stages.
    write = inheritable_thread_target(spark)(lambda item: put(item[0], item[1](t)))
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(write, results.items()))
    if done["agg_q_q15_trend"]:
        trend = load_table(spark, root, "agg_q_q15_trend")
        put("agg_q_q15_slopes", scores.slopes_of(trend))
        put("agg_q_q15_first_last", scores.first_last_of(trend))
    return done
