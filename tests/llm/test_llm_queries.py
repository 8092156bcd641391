"""Every registered query against its SQL, and what the results must look like."""

import pytest

import __spark_entry__ as entry_module
from cohortwise.llm import queries as llm
from compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
TABLES = {"op4": "pages", "op9": "embeddings"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(llm.queries()[name](spark, FOLDER), con, llm.oracle_sql()[name]) == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
    assert set(entry_module.queries()) >= {*llm.queries(), "pipeline"}


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op3_source_mixing", "op4_url_cascade",
                                  "op5_suffix_dedup", "op7_license_scan", "op8_toxicity", "op9_embedding_dedup",
                                  "op11_merkle_manifest"])
def test_one_row_per_row(spark, name):
    table = TABLES.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert llm.queries()[name](spark, FOLDER).count() == rows


@pytest.mark.parametrize("name", ["op3_source_mixing", "op7_license_scan"])
def test_native_queries_run_no_python(spark, name):
    plan = llm.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert node not in plan
