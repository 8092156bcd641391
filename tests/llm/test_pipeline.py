"""The stages one by one on rows that each of them is made for."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from brute import near_duplicates, repeats, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(9)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rn", "st", "nd")]
    passage = " ".join(draw.choice(pool) for _ in range(120))
    rows, labels = [], []
    for i in range(160):
        text = [draw.choice(pool) for _ in range(draw.randint(40, 90))]
        if i % 8 == 1:
            for _ in range(6):
                text[draw.randrange(len(text))] = draw.choice(["grobian", "flegel"])
        body = " ".join(text)
        if i % 10 == 4:
            body += " " + passage
        rows.append((i, body, "xx", ["hot", "hot", "b", None][i % 4], len(body)))
        labels.append((i, 1, int(i % 8 == 1)))
    rows += [(1000 + k, rows[0][1], "xx", "b", 5) for k in range(5)]
    rows += [(2000, None, None, None, None), (2001, "", "xx", "b", 0), (None, "alone in the world", None, "c", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_dedup", "suffix_dedup", "source_mixing", "best_fit_packing"]

    clean = stages["toxicity"](spark, docs, folder)
    kept = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns
    assert set(before) - set(kept) == {i for i in range(160) if i % 8 == 1}

    single = stages["minhash_dedup"](spark, clean, folder)
    left = {r["doc_id"]: r for r in single.collect()}
    want = near_duplicates([(i, r["text"]) for i, r in kept.items() if i is not None], 5, 80)
    assert set(left) - {None} == {i for i, (_, least) in want.items() if i == least} and None in left

    cut = stages["suffix_dedup"](spark, single, folder)
    order = list(left)
    removed = dict(zip(order, repeats([left[i]["text"] for i in order], corpus_pipeline.REPEAT_BYTES), strict=True))
    assert any(r[1] for r in removed.values())
    for r in cut.collect():
        if left[r["doc_id"]]["text"] is not None:
            assert r["text"].encode() == removed[r["doc_id"]][3] and r["n_chars"] == len(r["text"])

    mix = stages["source_mixing"](spark, cut, folder)
    assert mix.columns == columns
    copies = Counter(r["doc_id"] for r in mix.collect())
    assert set(copies) <= set(left) and max(copies.values()) <= 2

    bins = stages["best_fit_packing"](spark, mix, folder).collect()
    placed = Counter(r["doc_id"] for r in bins if r["piece"] == 0)
    assert placed == copies
    sizes = {r["doc_id"]: len(words(r["text"])) for r in cut.collect()}
    assert sum(r["n_words"] for r in bins) == sum(sizes[i] * n for i, n in copies.items())


def test_run_equals_the_stages(spark, folder):
    first, again = (corpus_pipeline.run(spark, folder).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, again)) and first


def test_run_on_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
