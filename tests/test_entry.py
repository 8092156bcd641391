"""Every registered query against its SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as entry_module
from compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
LLM = {*entry_module._LLM_QUERIES}  # tested in tests/llm, if it is there
QUERIES = {k: v for k, v in entry_module.queries().items() if k not in LLM}
ORACLE = {k: v for k, v in entry_module.oracle_sql().items() if k not in LLM}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"approx_score_quantiles"}  # see approx_score_check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


PLANNED = [
    "concept_fail", "group_attendance", "student_risk", "risk_ranking", "timing_band_score",
    "weekly_timeline_trimmed", "merge_candidates", "course_concept_grid", "platform_kpis",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_in_the_engine(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["concept_fail"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "struct<l_partkey:bigint,l_quantity:double>" in plan
    assert "orders.parquet" not in plan
