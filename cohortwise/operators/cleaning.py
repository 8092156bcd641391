"""Coercion and repair of raw columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to DOUBLE; unreadable values and NaN become NULL."""

    def number(c: str):
        value = F.col(c).try_cast("double")
        return F.when(~F.isnan(value), value)

    return df.withColumns({c: number(c) for c in cols if c in df.columns})


def to_timestamp_ntz(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Parse ISO timestamps without a zone; anything else becomes NULL."""
    return df.withColumns(
        {c: F.col(c).try_cast("timestamp_ntz") for c in cols if c in df.columns}
    )


def null_outside(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Blank values outside [lo, hi]; the rows stay."""
    return df.withColumn(col, F.when(F.col(col).between(lo, hi), F.col(col)))


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def enrich_students(students: DataFrame, groups: DataFrame, courses: DataFrame) -> DataFrame:
    """Students with their group's name, course and instructor.

    The joins carry no hint: group and course lists are broadcast when their
    measured size allows and merged otherwise.
    """
    of_group = groups.select("group_id", "course_id", "instructor", "group_name")
    of_course = courses.select("course_id", "course_name")
    return students.join(of_group, "group_id", "left").join(of_course, "course_id", "left")
