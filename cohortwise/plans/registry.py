"""Named reports over the eight tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from cohortwise.plans import activity, cohorts, overview, scores
from cohortwise.sources.tables import TABLES, CohortTables

Report = Callable[[CohortTables], DataFrame]


def _raw(name: str) -> Report:
    return lambda t: t.get(name)


def reports(
    event_grain: str = "month",
    date_grain: str | None = None,
    type_labels: Mapping[str, str] = scores.TYPE_LABELS,
    first_kind: str = "assignment",
) -> dict[str, Report]:
    """Every report by name.

    ``event_grain`` is the period of the activity halves, ``date_grain`` the
    truncation of assessment dates in the grade trends, ``type_labels`` the display names of
    assessment types, ``first_kind`` the type whose first score may give a warning.
    """
    plain = [
        overview.platform_kpis, overview.student_risk, overview.concept_fail,
        overview.group_attendance, overview.attendance_summary, overview.low_attendance_groups, overview.group_health,
        overview.monthly_attendance, overview.group_month_attendance, overview.grade_by_course,
        overview.risk_by_course, overview.top_cities, overview.students_by_group_course,
        scores.score_by_type, scores.score_box_by_type, scores.score_outliers_by_type,
        scores.score_density_by_type, scores.assessment_type_frequency, scores.score_histogram,
        scores.most_volatile_type, scores.approx_score_quantiles, scores.approx_score_check,
        scores.score_by_course, scores.course_grade_gap, scores.score_box_by_course,
        scores.attendance_vs_grade, scores.quartile_grade, scores.attendance_grade_corr,
        scores.attendance_grade_ols, scores.engagement_vs_grade, scores.engagement_grade_corr,
        scores.engagement_grade_ols, scores.submission_timing, scores.timing_band_score,
        scores.late_vs_ontime, scores.submission_ols, scores.score_box_by_lateness,
        activity.event_share, activity.event_share_labelled, activity.concept_fail_by_course,
        activity.top_failing_concepts, activity.biggest_weak_spot, activity.course_concept_grid, activity.worst_concept,
        activity.worst_concept_trend, activity.worst_concept_change, activity.weekly_timeline,
        activity.weekly_timeline_trimmed, activity.dip_week, activity.month_dow_heatmap,
        activity.month_dow_grid, activity.age_band_stats, activity.age_band_leaders,
        cohorts.stated_vs_true, cohorts.overcounted_groups, cohorts.size_audit_totals,
        cohorts.group_sizes, cohorts.merge_candidates, cohorts.top_merge_candidates,
        cohorts.student_segments, cohorts.segment_profile, cohorts.course_labels,
        cohorts.decision_inputs, cohorts.decisions,
        overview.course_modules, overview.oversized_groups, overview.enriched_students,
        overview.students_of_low_groups, overview.group_rate_texts,
        activity.cumulative_attendance,
    ]
    named: dict[str, Report] = {f"raw_{name}": _raw(name) for name in TABLES}
    named |= {report.__name__: report for report in plain}
    named |= {
        "student_features": cohorts.features,
        "student_features_scaled": cohorts.scaled_features,
        "activity_decline": lambda t: cohorts.activity_decline(t, event_grain),
        "risk_ranking": lambda t: cohorts.risk_ranking(t, event_grain),
        "top_at_risk": lambda t: cohorts.top_at_risk(t, event_grain),
        "risk_tiers": lambda t: cohorts.risk_tiers(t, event_grain),
        "grade_trend": lambda t: scores.grade_trend(t, date_grain),
        "trend_slopes": lambda t: scores.trend_slopes(t, date_grain),
        "first_last": lambda t: scores.first_and_last(t, date_grain),
        "first_score_warning": lambda t: scores.first_score_warning(t, kind=first_kind),
        "assessment_label_frequency": lambda t: scores.assessment_label_frequency(t, type_labels),
        "score_box_by_label": lambda t: scores.score_box_by_label(t, type_labels),
        "score_density_by_label": lambda t: scores.score_density_by_label(t, type_labels),
        "trajectory_counts": lambda t: scores.trajectory_counts(t, date_grain),
    }
    return named
