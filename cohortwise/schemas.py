"""Declared schemas of the eight input tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "courses": _schema(
        course_id=_S, course_name=_S, category=_S, difficulty_level=_S,
        duration_weeks=_I, short_description=_S, modules=_S, is_active=_B,
    ),
    "groups": _schema(
        group_id=_S, group_name=_S, course_id=_S, stated_num_students=_I,
        session_day=_S, session_time=_S, instructor=_S,
    ),
    "students": _schema(
        student_id=_S, full_name=_S, age=_D, city=_S, group_id=_S, enrollment_date=_TS,
    ),
    "grades": _schema(
        assessment_id=_S, student_id=_S, group_id=_S, course_id=_S, type=_S, score=_D, date=_TS,
    ),
    "attendance": _schema(student_id=_S, group_id=_S, status=_S, session_datetime=_TS),
    "concepts": _schema(
        student_id=_S, course_id=_S, concept_name=_S, mastery_status=_S,
        score_pct=_D, timestamp=_TS,
    ),
    "engagement": _schema(student_id=_S, event_type=_S, event_datetime=_TS, duration_seconds=_D),
    "submissions": _schema(
        assessment_id=_S, student_id=_S, deadline=_TS, submitted_at=_TS, is_late=_B,
    ),
}

#: Columns read as text and coerced afterwards, bad values becoming NULL.
DIRTY_NUMBERS: dict[str, list[str]] = {
    "students": ["age"],
    "grades": ["score"],
    "concepts": ["score_pct"],
    "engagement": ["duration_seconds"],
}
DIRTY_TIMES: dict[str, list[str]] = {
    "students": ["enrollment_date"],
    "grades": ["date"],
    "attendance": ["session_datetime"],
    "concepts": ["timestamp"],
    "engagement": ["event_datetime"],
    "submissions": ["deadline", "submitted_at"],
}
