"""Clusters of students and the words for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.features import FEATURES
from cohortwise.operators.kmeans import assigned, best_kmeans
from cohortwise.operators.ordering import exact_quantiles
from cohortwise.operators.scaling import zscore
from cohortwise.session import pinned

# Segment labels and the limits that lead to them.
HIGH_ACHIEVERS = "🏆 High Achievers"
AT_RISK = "🚨 At-Risk / Disengaged"
STRUGGLING = "⚡ Engaged but Struggling"
AVERAGE = "📈 Average / Improving"


def cluster_students(
    features: DataFrame, cols: Sequence[str] = tuple(FEATURES), k: int = 4, seed: int = 42, n_init: int = 10,
) -> DataFrame:
    """Add ``cluster``: k-means on the z-scored columns, best of several starts.

    Starts are drawn by a hash of the student, so the result depends on the rows only. Clusters are numbered
    by grade, then attendance of their centres, highest first.
    """
    cols = list(cols)
    scaled_cols = [f"z_{c}" for c in cols]
    shadow = features.withColumns({f"z_{c}": F.col(c).cast("double") for c in cols})
    points = pinned(zscore(shadow, scaled_cols).select("student_id", *cols, *scaled_cols))
    centres = best_kmeans(points, "student_id", scaled_cols, k, seed, n_init).centres
    if not centres:
        return points.select("student_id", *cols, F.lit(None).cast("int").alias("cluster"))
    ranked = [cols.index(c) for c in ("avg_grade", "att_rate") if c in cols] or [0]
    ordered = sorted(centres, key=lambda centre: [-centre[i] for i in ranked])
    return assigned(points, scaled_cols, ordered, "cluster").drop(*scaled_cols)


def segment_rule(grade: Column, att: Column, logins: Column, typical_logins: Column) -> Column:
    return (
        F.when((grade >= 75) & (att >= 75), HIGH_ACHIEVERS)
        .when((grade < 60) & (att < 50), AT_RISK)
        .when((logins >= typical_logins) & (grade < 70), STRUGGLING)
        .otherwise(AVERAGE)
    )


def label_clusters(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Add ``segment``, the word for each cluster's mean student."""
    means = df.na.drop(subset=[cluster]).groupBy(cluster).agg(
        F.avg("avg_grade").alias("_grade"),
        F.avg("att_rate").alias("_att"),
        F.avg("logins").alias("_logins"),
    )
    typical = exact_quantiles(df, [], "logins", {"m": 0.5}).scalar()
    labels = means.select(
        cluster, segment_rule(F.col("_grade"), F.col("_att"), F.col("_logins"), typical).alias("segment")
    )
    return df.join(labels, [cluster], "left")


def segment_profile(df: DataFrame, cols: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Size and mean measures of each segment."""
    means = [F.avg(c).alias(c) for c in cols]
    return df.groupBy("segment").agg(F.count(F.lit(1)).alias("students"), *means)
