"""Intermediates that reports of one session share."""

import pytest
from school import as_tables, school
from tests_support import same_rows

from cohortwise.plans.registry import reports
from cohortwise.plans.shared import SharedFrames, shared_tables

NAMES = ["group_attendance", "monthly_attendance", "student_risk", "risk_ranking", "concept_fail", "weekly_timeline"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    """Tables read anew from files at every call, as two reports would do."""
    path = str(tmp_path / "attendance")
    made = as_tables(spark, school())
    made.get("attendance").write.parquet(path)
    return lambda: made.with_table("attendance", spark.read.parquet(path))


def test_two_reports_read_attendance_once(tables):
    frames = SharedFrames()
    try:
        by_name = reports()
        for name in NAMES[:2]:
            found = by_name[name](shared_tables(tables(), frames))
            assert "InMemoryTableScan" in plan(found) and len(frames) == 1
        # Outside the stored frame no table scan is left in the second report but for the groups.
        assert "attendance" not in plan(found).replace("attendance_rate", "").split("InMemoryRelation")[0]
    finally:
        frames.release()
    assert len(frames) == 0 and "InMemoryTableScan" not in plan(reports()[NAMES[0]](tables()))


def test_shared_reports_have_the_same_rows(tables):
    frames, alone, by_name = SharedFrames(), tables(), reports()
    want = {name: by_name[name](alone).toPandas() for name in NAMES}
    try:
        for name in NAMES:
            got = by_name[name](shared_tables(tables(), frames)).toPandas()
            order = list(got.columns)
            key = lambda pdf: pdf.round(9).astype(str).sort_values(order).reset_index(drop=True)
            assert key(got).equals(key(want[name])), name
        assert len(frames) <= 3
    finally:
        frames.release()


def test_frames_expire_and_are_derived_anew(spark):
    now = [0.0]
    frames = SharedFrames(seconds=10, clock=lambda: now[0])
    first = frames.share(spark.range(5).selectExpr("id * 2 AS x"))
    assert frames.share(spark.range(5).selectExpr("id * 2 AS x")) is first
    other = frames.share(spark.range(5).selectExpr("id * 3 AS x"))
    assert other is not first and len(frames) == 2
    now[0] = 10.0
    again = frames.share(spark.range(5).selectExpr("id * 2 AS x"))
    assert again is not first and len(frames) == 1 and not first.is_cached
    same_rows(first, again)
    frames.release()
    assert not again.is_cached and len(frames) == 0


def test_a_callers_own_stored_frame_stays(spark):
    mine, frames = spark.range(7).selectExpr("id + 1 AS y").persist(), SharedFrames()
    assert frames.share(mine) is mine and len(frames) == 0
    frames.release()
    assert mine.storageLevel.useMemory
    mine.unpersist()
