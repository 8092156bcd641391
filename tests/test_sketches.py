"""Approximate quantiles against exact ranks."""

import numpy as np
import pytest

from cohortwise.operators import sketches
from cohortwise.plans import scores
from school import as_tables, school

PROBS = {"low": 0.01, "q1": 0.25, "median": 0.5, "p99": 0.99}


def frame(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 8, 20_000), rng.normal(0, 1, 20_000), np.full(10_000, 7.0)])
    rows = [("ab"[i % 2], i % 12, float(v)) for i, v in enumerate(values)]
    rows += [("a", 1, None), ("b", 2, float("nan")), (None, 3, 1.0), ("c", 1, None), ("d", 1, 4.0)]
    return spark.createDataFrame(rows, "k string, part int, v double").repartition(8)


def test_merged_parts_keep_the_rank_error(spark):
    df = frame(spark)
    parts = sketches.quantile_sketches(df, ["k", "part"], "v")
    assert parts.count() == 13
    merged = sketches.merged_sketches(parts, "k")
    found = sketches.sketched_quantiles(merged, PROBS).toPandas().set_index("k")
    assert sorted(found.index) == ["a", "b", "d"] and list(found["n"].sort_index()) == [25_000, 25_000, 1]
    assert tuple(found.loc["d", list(PROBS)]) == (4.0,) * 4
    data = df.toPandas().dropna()
    for key in "ab":
        values = data[data["k"] == key]["v"].to_numpy()
        for name, p in PROBS.items():
            got = found.loc[key, name]
            assert (values < got).mean() - 0.02 <= p <= (values <= got).mean() + 0.02
    size = merged.selectExpr("max(length(sketch)) AS n").first()["n"]
    assert size < 20_000


@pytest.mark.parametrize("keys", [["k"], []])
def test_check_finds_wrong_ranks(spark, keys):
    df = frame(spark)
    found = sketches.sketched_quantiles(sketches.merged_sketches(sketches.quantile_sketches(df, ["k", "part"], "v"), keys), PROBS)
    assert {r["within"] for r in sketches.within_rank(df, keys, "v", found, PROBS, 0.02).collect()} == {True}
    wrong = found.where("n > 1").withColumn("median", found["median"] + 1e6)
    checks = sketches.within_rank(df, keys, "v", wrong, PROBS, 0.02).collect()
    assert {r["name"] for r in checks if not r["within"]} == {"median"}


def test_no_rows(spark):
    none = frame(spark).limit(0)
    assert sketches.quantile_sketches(none, "k", "v").count() == 0


def test_stored_sketches_are_read(spark):
    t = as_tables(spark, school())
    stored = scores.score_sketches(t)
    again = t.with_table("score_sketches", stored.limit(0))
    assert scores.approx_score_quantiles(again).count() == 0
    kinds = {r["type"] for r in scores.approx_score_quantiles(t.with_table("score_sketches", stored)).collect()}
    assert kinds and all(r["within"] for r in scores.approx_score_check(t).collect())
