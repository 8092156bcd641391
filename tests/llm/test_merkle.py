"""The manifest against a tree built in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cohortwise.llm import merkle

SCHEMA = "doc_id long, lang string, text string, key string, pos int, digest string, n string, row string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climbed(nodes, fanout):
    """(root, [siblings left to right per level] for each node)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, place in zip(paths, at, strict=True):
            run = range(place - place % fanout, min(place - place % fanout + fanout, len(level)))
            path.append(("".join(level[i] for i in run if i < place), "".join(level[i] for i in run if i > place)))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [place // fanout for place in at]
    return level[0], paths


def brute(rows, fanout):
    groups = {}
    for doc, lang, text in rows:
        groups.setdefault(lang, []).append((doc is not None, doc or 0, leaf(doc, lang, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climbed([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, ups = climbed([tops[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, ups, strict=True):
        for (known, doc, digest), path in zip(sorted(groups[g]), tops[g][1], strict=True):
            out.append((doc if known else None, digest, tops[g][0], root, [*path, *up]))
    return sorted(out, key=repr)


def manifested(spark, rows, fanout):
    df = spark.createDataFrame([(*r, "k", 3, "d", "n", "r") for r in rows], SCHEMA).repartition(3)
    leaves = df.withColumn("leaf", merkle.leaf_of(F.col("doc_id"), F.col("lang"), F.col("text")))
    return merkle.manifest(leaves, "lang", ["doc_id"], fanout)


ROWS = (
    [(i, "en", f"text {i}") for i in range(23)] + [(i, "é", "same") for i in range(5)] + [(7, "z", "lone")]
    + [(3, None, None), (None, None, ""), (None, "en", "x"), (4, "en", "tie"), (4, "en", "text 4"), (4, "", "e")]
)


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 9), (5, 4)])
def test_matches_plain_tree(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "_BLOCK_ROWS", block)
    found = manifested(spark, ROWS, fanout)
    assert found.columns == ["doc_id", "lang", "text", "key", "pos", "digest", "n", "row", "leaf", "subroot", "root", "path"]
    assert {(r["key"], r["pos"], r["digest"], r["n"], r["row"]) for r in found.collect()} == {("k", 3, "d", "n", "r")}
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in found.collect()]
    assert sorted(got, key=repr) == brute(ROWS, fanout)


def test_folding_finds_changed_rows(spark):
    found = manifested(spark, ROWS, 2)
    folds = found.select(
        (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("whole"),
        (merkle.folded(F.sha2(F.lit("other"), 256), F.col("path")) == F.col("root")).alias("changed"),
        F.length(merkle.proof_of(F.col("path"))).alias("size"), F.size("path").alias("levels"),
    ).collect()
    assert all(r["whole"] and not r["changed"] for r in folds)
    assert all(r["size"] % 64 == 0 and r["size"] <= 64 * r["levels"] for r in folds)


def test_one_row_and_none(spark):
    (one,) = manifested(spark, [(1, "en", "a")], 2).collect()
    assert one["root"] == one["subroot"] == one["leaf"] == leaf(1, "en", "a") and one["path"] == []
    assert manifested(spark, [], 2).collect() == []


def test_plan_keeps_groups_apart(spark):
    nodes = spark.range(10).selectExpr("concat('g', id % 2) AS key", "id AS pos", "10L AS n", "sha2(string(id), 256) AS digest")
    plan = merkle._climbed(nodes, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(key#\d+, block#", plan) and plan.count("Exchange") == 1
