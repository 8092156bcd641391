"""Likeness of groups by their mean result per concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import aggregates as A
from cohortwise.operators.grouping import mean_by


def concept_profiles(concepts: DataFrame, members: DataFrame) -> DataFrame:
    """Mean ``score_pct`` per (group, concept).

    The membership list is broadcast when its measured size allows. Otherwise
    both sides meet on the student, and adaptive execution splits a student
    holding very many results. Only group means are shuffled afterwards.
    """
    results = concepts.na.drop(subset=["concept_name", "score_pct"])
    listed = members.select("student_id", "group_id").na.drop().distinct()
    return mean_by(
        results.join(listed, "student_id"), ["group_id", "concept_name"], "score_pct", "level"
    )


def profile_similarity(
    profiles: DataFrame, target: Column, min_common: int = 3, exclude_self: bool = False
) -> DataFrame:
    """Pearson r between the target group's profile and every group's.

    Needs more than ``min_common`` shared concepts. The target matches itself
    with r = 1 unless excluded.
    """
    # Both sides read the same profiles, so their shuffle is made once.
    level = F.max(F.when(F.col("group_id") == target, F.col("level")))
    wanted = profiles.groupBy("concept_name").agg(level.alias("target_level"))
    wanted = wanted.where(F.col("target_level").isNotNull())
    others = profiles.where(F.col("group_id") != target) if exclude_self else profiles
    return (
        others.join(wanted, "concept_name")
        .groupBy("group_id")
        .agg(
            F.count(F.lit(1)).alias("common"),
            A.pearson("target_level", "level").alias("similarity"),
        )
        .where(F.col("common") > min_common)
    )
