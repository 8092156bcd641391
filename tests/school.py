"""A small, messy school: eight pandas tables with gaps, ties and a hot student."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd

from cohortwise.schemas import SCHEMAS
from cohortwise.operators.cleaning import enrich_students
from cohortwise.sources.tables import CohortTables

KINDS = ["login", "video_watch", "resource_download", "quiz_attempt", "forum_post", "mystery"]


def school(seed: int = 5) -> dict[str, pd.DataFrame]:
    rng = random.Random(seed)
    start = dt.datetime(2025, 1, 1, 9)

    def some_time():
        return None if rng.random() < 0.03 else start + dt.timedelta(hours=rng.randrange(24 * 170))

    courses = [(f"C{i}", f"Course {i}") for i in range(3)]
    # The last group has no students and the one before states a size of zero.
    groups = [(f"G{i}", f"Group {i}", f"C{i % 3}", [40, 30, 25, 0, 10][i], "Eng. A") for i in range(5)]
    students = [
        (f"S{i:03d}", f"Name {i}", rng.choice([None, 17, 19, 21, 24, 28, 44]),
         rng.choice(["Cairo", "Giza", None]), f"G{rng.choice([0, 0, 1, 1, 2, 2, 3])}")
        for i in range(80)
    ]
    group_of = {s[0]: s[4] for s in students}
    course_of = {g[0]: g[2] for g in groups}
    ids = [s[0] for s in students[:70]]  # ten students have no rows at all

    def someone():
        return "S001" if rng.random() < 0.33 else rng.choice(ids)

    attendance, concepts, engagement, grades, submissions = [], [], [], [], []
    for _ in range(900):
        who = someone()
        attendance.append((who, group_of[who], rng.choice(["attended", "attended", "absent", None]), some_time()))
    for _ in range(900):
        who = someone()
        concepts.append((
            who, course_of[group_of[who]], f"K{rng.randrange(7)}",
            rng.choice(["failed", "passed", "in_progress", None]),
            rng.choice([None, round(rng.uniform(0, 100), 1)]), some_time(),
        ))
    for _ in range(700):
        engagement.append((someone(), rng.choice(KINDS), some_time(), rng.choice([None, 30.0, 900.0, 7200.0])))
    for i in range(500):
        who = someone()
        grades.append((
            f"A{i % 90}", who, group_of[who], course_of[group_of[who]],
            rng.choice(["quiz", "assignment", "practical", "exam"]),
            None if rng.random() < 0.05 else round(rng.uniform(20, 100), 1),
            start + dt.timedelta(days=7 * rng.randrange(12)),
        ))
    for g in grades[:400]:
        due = start + dt.timedelta(days=rng.randrange(100))
        sent = None if rng.random() < 0.05 else due - dt.timedelta(hours=rng.choice([-300, -3, 0.5, 6, 12, 90, 250, 700]))
        submissions.append((g[0], g[1], due, sent, None if sent is None else sent > due))
    names = {
        "courses": ["course_id", "course_name"],
        "groups": ["group_id", "group_name", "course_id", "stated_num_students", "instructor"],
        "students": ["student_id", "full_name", "age", "city", "group_id"],
        "attendance": ["student_id", "group_id", "status", "session_datetime"],
        "concepts": ["student_id", "course_id", "concept_name", "mastery_status", "score_pct", "timestamp"],
        "engagement": ["student_id", "event_type", "event_datetime", "duration_seconds"],
        "grades": ["assessment_id", "student_id", "group_id", "course_id", "type", "score", "date"],
        "submissions": ["assessment_id", "student_id", "deadline", "submitted_at", "is_late"],
    }
    data = {
        "courses": courses, "groups": groups, "students": students, "attendance": attendance,
        "concepts": concepts, "engagement": engagement, "grades": grades, "submissions": submissions,
    }
    return {n: pd.DataFrame(data[n], columns=names[n], dtype=object) for n in names}


def as_tables(spark, frames) -> CohortTables:
    loaded = {}
    for name, pdf in frames.items():
        fields = [f for f in SCHEMAS[name].fields if f.name in pdf.columns]
        kinds = {f.name: f.dataType.typeName() for f in fields}
        records = []
        for row in pdf.itertuples(index=False):
            cells = []
            for c, v in zip(pdf.columns, row):
                if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
                    cells.append(None)
                elif kinds[c] == "double":
                    cells.append(float(v))
                elif kinds[c] == "timestamp_ntz":
                    cells.append(pd.Timestamp(v).to_pydatetime())
                else:
                    cells.append(v)
            records.append(tuple(cells))
        schema = ", ".join(f"`{c}` {SCHEMAS[name][c].dataType.simpleString()}" for c in pdf.columns)
        loaded[name] = spark.createDataFrame(records, schema).repartition(4)
    loaded["students"] = enrich_students(loaded["students"], loaded["groups"], loaded["courses"])
    return CohortTables.from_frames(loaded)
