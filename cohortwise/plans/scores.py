"""Scores: by assessment type, by course, against attendance and submission timing, over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import aggregates as A
from cohortwise.functions import bands as B
from cohortwise.functions.periods import month_key
from cohortwise.functions.scalars import (
    hours_between, in_open_range, map_values, seconds_to_hours, title_case,
)
from cohortwise.operators.distribution import (
    box_outliers, box_stats_by, density_by, describe_by, histogram,
)
from cohortwise.operators.features import student_metrics
from cohortwise.operators.grouping import (
    agg_by, arg_extreme, count_by, first_last, frequency, mean_by, scalars,
)
from cohortwise.operators.ordering import quartile_band, rank_within
from cohortwise.operators.regression import line_from_sums, linreg_by, ols_by
from cohortwise.operators.sketches import (
    merged_sketches, quantile_sketches, sketched_quantiles, within_rank,
)
from cohortwise.sources.tables import CohortTables

# Display names of the assessment types, grid of the density curves.
TYPE_LABELS = {
    "quiz": "Quiz",
    "assignment": "Assignment",
    "practical": "Practical",
    "exam": "Exam",
}
SCORE_GRID = [float(x) for x in range(0, 101, 5)]


APPROX_SHARES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}

# --- by assessment type -------------------------------------------------------------------


def score_by_type(t: CohortTables) -> DataFrame:
    """Mean, deviation and median of the scores of each assessment type."""
    return describe_by(t.get("grades", "type", "score"), "type", "score").drop("count")


def score_box_by_type(t: CohortTables) -> DataFrame:
    return box_stats_by(t.get("grades", "type", "score"), "type", "score")


def score_outliers_by_type(t: CohortTables) -> DataFrame:
    return box_outliers(t.get("grades", "type", "score"), "type", "score")


def score_sketches(t: CohortTables, k: int = 400) -> DataFrame:
    """A quantile sketch of the scores of each assessment type and month; stored by a refresh."""
    if t.has("score_sketches"):
        return t.get("score_sketches")
    grades = t.get("grades", "type", "score", "date").withColumn("month", month_key("date"))
    return quantile_sketches(grades.fillna({"month": ""}), ["type", "month"], "score", k)


def approx_score_quantiles(t: CohortTables) -> DataFrame:
    """Approximate quartiles and 95th percentile per assessment type, merged from its months."""
    return sketched_quantiles(merged_sketches(score_sketches(t), "type"), APPROX_SHARES)


def approx_score_check(t: CohortTables, bound: float = 0.02) -> DataFrame:
    """Whether each approximate quantile's true rank lies within ``bound`` of its share."""
    grades = t.get("grades", "type", "score")
    return within_rank(grades, "type", "score", approx_score_quantiles(t), APPROX_SHARES, bound)


def score_density_by_type(t: CohortTables, grid: Sequence[float] = tuple(SCORE_GRID)) -> DataFrame:
    return density_by(t.get("grades", "type", "score"), "type", "score", grid)


def assessment_type_frequency(t: CohortTables) -> DataFrame:
    return frequency(t.get("grades", "type"), "type")


def assessment_label_frequency(
    t: CohortTables, labels: Mapping[str, str] = TYPE_LABELS
) -> DataFrame:
    """The same under display names; types without one are left out."""
    named = t.get("grades", "type").select(map_values("type", labels).alias("label"))
    return frequency(named, "label")


def _labelled_scores(t: CohortTables, labels: Mapping[str, str]) -> DataFrame:
    named = map_values("type", labels).alias("label")
    return t.get("grades", "type", "score").select(named, "score").na.drop(subset=["label"])


def score_box_by_label(t: CohortTables, labels: Mapping[str, str] = TYPE_LABELS) -> DataFrame:
    """Box summary under display names; types without one are left out."""
    return box_stats_by(_labelled_scores(t, labels), "label", "score")


def score_density_by_label(
    t: CohortTables, labels: Mapping[str, str] = TYPE_LABELS, grid: Sequence[float] = tuple(SCORE_GRID)
) -> DataFrame:
    return density_by(_labelled_scores(t, labels), "label", "score", grid)


def most_volatile_type(t: CohortTables) -> DataFrame:
    """The assessment type whose scores spread widest."""
    widest = arg_extreme(score_by_type(t), "std", "type")
    return widest.select(title_case("type").alias("type"), "std")


def score_histogram(t: CohortTables, bins: int = 40) -> DataFrame:
    return histogram(t.get("grades", "type", "score"), "type", "score", 0.0, 100.0, bins)


# --- by course ----------------------------------------------------------------------------


def _course_scores(t: CohortTables) -> DataFrame:
    grades = t.get("grades", "course_id", "score")
    return grades.join(t.get("courses", "course_id", "course_name"), "course_id", "left")


def score_by_course(t: CohortTables) -> DataFrame:
    """Mean, deviation, median and count per course, best first."""
    return describe_by(_course_scores(t), "course_name", "score").orderBy(
        F.desc_nulls_last("mean"), "course_name"
    )


def course_grade_gap(t: CohortTables) -> DataFrame:
    """Best and worst course by mean score, their gap, and the widest spread.

    Of equal courses the first by name is the worst and the last by name the best or widest.
    """
    scores = _course_scores(t)
    stats = agg_by(scores, "course_name", mean=F.avg("score"), std=F.stddev_samp("score"))

    def order(measure: str) -> Column:
        return F.when(F.col(measure).isNotNull(), F.struct(measure, "course_name"))

    return scalars(
        stats,
        best_course=F.max_by("course_name", order("mean")),
        worst_course=F.min_by("course_name", order("mean")),
        gap=F.max("mean") - F.min("mean"),
        widest_course=F.max_by("course_name", order("std")),
        widest_std=F.max("std"),
    )


def score_box_by_course(t: CohortTables) -> DataFrame:
    return box_stats_by(_course_scores(t), "course_name", "score")


def first_score_warning(t: CohortTables, limit: float = 55.0, kind: str = "assignment") -> DataFrame:
    """Students whose first scored assessment of the kind lies below ``limit``."""
    scored = t.get("grades", "student_id", "assessment_id", "date", "type", "score")
    scored = scored.where((F.col("type") == kind) & F.col("score").isNotNull())
    order = F.struct("date", "assessment_id", "score")
    first = agg_by(
        scored, "student_id", first_date=F.min("date"), first_score=F.min_by("score", order)
    )
    return first.where(F.col("first_score") < limit)


# --- against attendance -------------------------------------------------------------------


def _attendance_and_grade(t: CohortTables) -> DataFrame:
    return student_metrics(t, "att_rate", "avg_grade", required=["att_rate", "avg_grade"])


def _with_names(t: CohortTables, df: DataFrame, *columns: str) -> DataFrame:
    return df.join(t.get("students", "student_id", *columns), "student_id", "left")


def attendance_vs_grade(t: CohortTables) -> DataFrame:
    """Each student's attendance, mean grade and attendance quartile."""
    banded = quartile_band(_attendance_and_grade(t), "att_rate", "student_id")
    return _with_names(t, banded, "course_name", "group_name")


def quartile_grade(t: CohortTables) -> DataFrame:
    """Mean grade per attendance quartile."""
    banded = quartile_band(_attendance_and_grade(t), "att_rate", "student_id")
    return mean_by(banded, ["band_ord", "band"], "avg_grade")


def attendance_grade_corr(t: CohortTables) -> DataFrame:
    r = scalars(
        _attendance_and_grade(t), students=F.count(F.lit(1)), r=A.pearson("att_rate", "avg_grade")
    )
    return r.withColumn("strength", B.strength("r"))


def attendance_grade_ols(t: CohortTables) -> DataFrame:
    """Trend line of grade on attendance per course."""
    named = _with_names(t, _attendance_and_grade(t), "course_name")
    return ols_by(named, "course_name", "att_rate", "avg_grade")


# --- against platform engagement ----------------------------------------------------------


def _engaged(t: CohortTables) -> DataFrame:
    measured = student_metrics(t, "avg_grade", "logins", "video_sec", required=["avg_grade"])
    return measured.select(
        "student_id",
        "avg_grade",
        F.coalesce("logins", F.lit(0)).alias("logins"),
        F.coalesce(seconds_to_hours("video_sec"), F.lit(0.0)).alias("video_hrs"),
    )


def engagement_vs_grade(t: CohortTables) -> DataFrame:
    """Graded students with logins and hours of video."""
    return _with_names(t, _engaged(t), "course_name")


def engagement_grade_corr(t: CohortTables) -> DataFrame:
    return scalars(
        _engaged(t),
        r_login=A.pearson("logins", "avg_grade"),
        r_video=A.pearson("video_hrs", "avg_grade"),
        mean_logins=F.avg("logins"),
    )


def engagement_grade_ols(t: CohortTables) -> DataFrame:
    """Trend line of grade on hours of video per course."""
    return ols_by(engagement_vs_grade(t), "course_name", "video_hrs", "avg_grade")


# --- against submission timing ------------------------------------------------------------


_PAIR = ["assessment_id", "student_id"]


def _buffered(t: CohortTables) -> DataFrame:
    subs = t.get("submissions", "assessment_id", "student_id", "deadline", "submitted_at", "is_late")
    return subs.withColumn("buffer_hours", hours_between("deadline", "submitted_at"))


def submission_timing(t: CohortTables) -> DataFrame:
    """Scored submissions with hours left before the deadline and timing band.

    Every grade row of the same assessment and student matches, as in the
    two-key join it reports. Adaptive execution splits over-full join partitions.
    """
    return (
        _buffered(t)
        .join(_known_scores(t), _PAIR)
        .withColumn("band_ord", B.timing_order("buffer_hours"))
        .withColumn("band", B.band_label("band_ord", B.TIMING_LABELS))
    )


def _known_scores(t: CohortTables) -> DataFrame:
    return t.get("grades", *_PAIR, "score").where(F.col("score").isNotNull())


def _paired(t: CohortTables, **sub_sums: Column) -> DataFrame:
    """Submission sums beside score sums, one row per (assessment, student).

    Sums over the two-key join factor into sums per side, so both sides are
    reduced before they meet and a repeated pair never multiplies into rows.
    """
    score = F.col("score").cast("double")
    sums = agg_by(
        _known_scores(t), _PAIR,
        _n=F.count(F.lit(1)).cast("double"), _y=F.sum(score), _yy=F.sum(score * score),
        _low=F.min(score), _high=F.max(score),
    )
    return agg_by(_buffered(t), _PAIR, **sub_sums).join(sums, _PAIR)


def timing_band_score(t: CohortTables) -> DataFrame:
    """Mean score per submission-timing band; empty bands are left out."""
    order = B.timing_order("buffer_hours")
    numbers = range(1, len(B.TIMING_LABELS) + 1)
    pairs = _paired(t, **{f"b{i}": F.count_if(order == i) for i in numbers})
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("band_ord"),
                F.sum(F.col(f"b{i}") * F.col("_n")).alias("rows"),
                F.sum(F.col(f"b{i}") * F.col("_y")).alias("total"),
            )
            for i in numbers
        ]
    )
    return (
        pairs.agg(cells.alias("cells"))
        .select(F.inline("cells"))
        .where(F.col("rows") > 0)
        .select(
            "band_ord",
            B.band_label("band_ord", B.TIMING_LABELS).alias("band"),
            (F.col("total") / F.col("rows")).alias("score"),
        )
    )


def late_vs_ontime(t: CohortTables) -> DataFrame:
    """Mean score of on-time and late submissions and the gap between them."""
    pairs = _paired(t, late=F.count_if(F.col("is_late")), ontime=F.count_if(~F.col("is_late")))

    def mean(flag: str) -> Column:
        return F.try_divide(F.sum(F.col(flag) * F.col("_y")), F.sum(F.col(flag) * F.col("_n")))

    return pairs.agg(mean("ontime").alias("ontime_avg"), mean("late").alias("late_avg")).withColumn(
        "gap", F.col("ontime_avg") - F.col("late_avg")
    )


def submission_ols(t: CohortTables, limit: float = 500.0) -> DataFrame:
    """Trend line of score on buffer hours, late and on time apart, |buffer| < limit."""
    x = F.when(in_open_range("buffer_hours", -limit, limit), F.col("buffer_hours"))
    sums = {}
    for name, late in (("late", F.col("is_late")), ("ontime", ~F.col("is_late"))):
        own = F.when(late, x)
        sums |= {
            f"{name}_n": F.count(own),
            f"{name}_x": A.total(own),
            f"{name}_xx": A.total(own * own),
            f"{name}_min": F.min(own),
            f"{name}_max": F.max(own),
        }
    pairs = _paired(t, **sums)
    cells = []
    for name, late in (("late", True), ("ontime", False)):
        n, sx, sxx = (F.col(f"{name}_{part}") for part in ("n", "x", "xx"))
        low, high = (F.when(n > 0, F.col(c)) for c in ("_low", "_high"))
        line = line_from_sums(
            n=F.nullif(F.sum(n * F.col("_n")), F.lit(0.0)),
            sx=F.sum(sx * F.col("_n")),
            sy=F.sum(n * F.col("_y")),
            sxx=F.sum(sxx * F.col("_n")),
            sxy=F.sum(sx * F.col("_y")),
            syy=F.sum(n * F.col("_yy")),
            x_moves=F.min(f"{name}_min") < F.max(f"{name}_max"),
            y_moves=F.min(low) < F.max(high),
        )
        cells.append(
            F.struct(F.lit(late).alias("is_late"), *[e.alias(part) for part, e in line.items()])
        )
    lines = pairs.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return lines.where(F.col("n") > 0).withColumn("n", F.col("n").cast("long"))


def score_box_by_lateness(t: CohortTables) -> DataFrame:
    """Box summary of late and on-time scores; each (pair, score) meets counts only."""
    sides = F.array(
        *[
            F.struct(F.lit(late).alias("is_late"), F.col(name).alias("subs"))
            for late, name in ((True, "late"), (False, "ontime"))
        ]
    )
    subs = agg_by(
        t.get("submissions", *_PAIR, "is_late"), _PAIR,
        late=F.count_if(F.col("is_late")), ontime=F.count_if(~F.col("is_late")),
    )
    values = count_by(_known_scores(t), [*_PAIR, "score"], "marks").join(subs, _PAIR)
    weighed = values.select("score", "marks", F.inline(sides)).where(F.col("subs") > 0)
    weighed = weighed.withColumn("weight", F.col("marks") * F.col("subs"))
    return box_stats_by(weighed, "is_late", "score", copies="weight")


# --- over successive assessments ----------------------------------------------------------


def grade_trend(t: CohortTables, grain: str | None = None) -> DataFrame:
    """Mean score of each group on its successive assessment dates.

    ``grain`` truncates dates (for example ``month``) before they are numbered.
    """
    when = F.col("date") if grain is None else F.trunc(F.to_date("date"), grain)
    graded = t.get("grades", "group_id", "date", "score").withColumn("_when", when)
    dated = mean_by(graded, ["group_id", "_when"], "score")
    numbered = rank_within(dated, "group_id", ["_when"], "seq")
    named = t.get("groups", "group_id", "group_name").na.drop(subset=["group_name"])
    return numbered.join(named, "group_id").select("group_id", "group_name", "seq", "score")


def slopes_of(trend: DataFrame) -> DataFrame:
    fits = linreg_by(trend, ["group_id", "group_name"], "seq", "score").drop("points")
    return fits.withColumn("direction", B.direction("slope")).orderBy(
        F.desc_nulls_last("slope"), "group_id"
    )


def trend_slopes(t: CohortTables, grain: str | None = None) -> DataFrame:
    """Points gained per assessment for groups with at least three, steepest first."""
    return slopes_of(grade_trend(t, grain))


def first_last_of(trend: DataFrame) -> DataFrame:
    return first_last(trend, "group_name", ["seq", "group_id"], "score")


def first_and_last(t: CohortTables, grain: str | None = None) -> DataFrame:
    """First and last mean score per group name."""
    return first_last_of(grade_trend(t, grain))


def trajectory_counts(t: CohortTables, grain: str | None = None) -> DataFrame:
    """How many groups climb and how many fall."""
    return scalars(
        trend_slopes(t, grain),
        up=F.count_if(F.col("direction") == "up"),
        down=F.count_if(F.col("direction") == "down"),
    )
