"""URL rules, licence phrases and toxicity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import WORD, base_places, judge, lowered
from cohortwise.llm import license_scan, toxicity, url_cascade
from cohortwise.llm.queries import URL_RULES, held_out
from cohortwise.llm.toxicity import Lexicon, folded_words

URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://EXAMPLE.COM/EN/", "http://example.com/en/x",
    "https://www.example.com/en/1?a=/en/", "https://a.www.example.com/en/", "http://xexample.com/en/", "http://a.net/es/", "http://net/fr/",
    "http://a.net/es", "http://a.net:80/es/", "http://a.net?x=/es/", "http://a.net#/es/", "http://a.com/en/", "x://y://example.com/en/",
    "http://é.com/", "http://.com/", "http://example.com/en/" + "a/" * 20_000, "http://" + "a." * 3000 + "net/es/",
    "http://a.net/es/\nb?c", "http://É.COM/É",
]


@pytest.mark.parametrize("bits", [1, 10])
def test_urls_equal_brute_force(spark, bits):
    rules = [*URL_RULES, ("example.com", "/en/x", "allow"), ("a.www.example.com", "", "block")]
    for chosen in (URL_RULES, rules):
        pages = spark.createDataFrame(
            [(i, u, "x", 1) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, rule int"
        )
        found = url_cascade.judge_urls(pages, chosen, bits_per_key=bits).collect()
        got = {r["page_id"]: tuple(r)[1:] for r in found}
        assert got == {i: judge(u, chosen) for i, u in enumerate([*URLS, *URLS])}


def test_urls_without_rules_rows_or_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in url_cascade.judge_urls(pages, []).collect()] == [(None, "a.com", "/x", None, "allow")]
    assert [tuple(r) for r in url_cascade.judge_urls(pages, URL_RULES).collect()] == [(None, "a.com", "/x", "com/", "allow")]
    assert url_cascade.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    listed = [f"in{i}" for i in range(500)]
    universe = [f"out{i}" for i in range(3000)] + listed[::2]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_cascade.build_cascade(frame([*listed, None, *listed]), frame([*universe, None]), bits_per_key=2)
    assert len(cascade.levels) > 2
    rows = url_cascade.keyed(frame([*listed, *universe])).collect()
    h1, h2 = (np.array([r[c] for r in rows], np.int64) for c in ("h1", "h2"))
    assert cascade.has(h1, h2).tolist() == [r["key"].startswith("in") for r in rows]
    with pytest.raises(ValueError):
        url_cascade.build_cascade(frame(listed), frame(universe), max_bytes=100)


TEXTS = [
    None, "", "...", "CC BY", "cc-by cc\nby CC  BY", "all rights all rights reserved", "ALL RIGHTS RESERVED. all rights reserved",
    "General Public License general public licence", "xcc by cc byx", "\u212acc by", "écc by cc by\u00a0x", "reserved rights all",
    "Licensed under the Apache License, Version 2.0.", "licensed by the apache license version 2", "Released under the MIT License",
    "mit license", "This work is licensed under the GNU General Public License, version 3.", "cc " * 3000 + "by", "reserved " * 5000,
    "Redistribution and use in source and binary forms with or without any modification are permitted",
]


def brute_labels(text, frequency):
    words = WORD.findall(lowered(text))
    labels, best = set(), 0.0
    for t in (*license_scan.BASE, *license_scan.TEMPLATES):
        rare = license_scan.rare_places(t, frequency, 1 if t in license_scan.BASE else 3)
        starts = {i - o for i, w in enumerate(words) for r, o in rare if w == r}
        for s in starts:
            same = [0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(t.words)]
            share = sum(same) / len(same) if all(same[k] for k in t.key_places) else 0.0
            if t in license_scan.BASE and share < 1:
                continue
            best = max(best, share)
            if share >= 0.8:
                labels.add(t.label)
    return ",".join(sorted(labels)), best


def test_licenses_equal_brute_force(spark, docs_of):
    draw = random.Random(1)
    pool = "all rights reserved cc by general public license the apache version 2 0 mit released under licensed".split()
    texts = TEXTS + [" ".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(150)]
    docs = docs_of(list(enumerate(texts)))
    words = docs.select(license_scan.license_words(F.col("text")).alias("words"))
    frequency = license_scan.document_frequencies(words, [*license_scan.BASE, *license_scan.TEMPLATES])
    for r in license_scan.scan_licenses(docs).collect():
        text = texts[r["doc_id"]]
        assert tuple(r)[1:6] == base_places(text), text
        labels, best = brute_labels(text, frequency)
        assert (r["labels"], round(r["score"], 9)) == (labels, round(best, 9)), text
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}


def test_licenses_null_ids_and_no_rows(docs_of):
    rows = license_scan.scan_licenses(docs_of([(None, "cc by"), (None, "cc by")])).collect()
    assert [r["n_base"] for r in rows] == [1, 1]
    assert license_scan.scan_licenses(docs_of([])).count() == 0


@pytest.mark.parametrize("written", ["Idiot", "1d10t", "id!ot", "іdіоt", "ｉｄｉｏｔ", "i.d.i.o.t", "idi\u200bot", "idiooot", "IDIOT!!!", "idiot$$$"])
def test_folding(written):
    assert folded_words(f"you {written} there")[1] == folded_words("idiot")[0]


def test_exceptions_void_hits_and_length_dilutes():
    lexicon = Lexicon({" scum": 3.0, " scumb": 4.0}, frozenset({" scumber "}), (-2.0, 10.0, 1.0))
    assert lexicon.features("scumber gaze") == lexicon.features(None) == lexicon.features("") == (0.0, 0.0)
    short, long = lexicon.features("scum"), lexicon.features("scum" + " fine" * 500)
    assert short[0] > long[0] > 0
    assert lexicon.features("scumbag")[1] > lexicon.features("scum")[1]
    assert (lexicon.score(np.array([short, (0.0, 0.0)])).round(6) > 0).all()


def test_exception_phrases_void_hits_of_their_words_only():
    lexicon = Lexicon({" trash": 3.0, " scum": 2.0}, frozenset({" trash can ", " pond scum "}), (0.0, 1.0, 1.0))
    assert lexicon.features("the trash can and pond scum") == (0.0, 0.0)
    assert lexicon.features("trash can trash")[1] == lexicon.features("trash x x")[1] > 0
    assert lexicon.features("pond scum scum")[1] == lexicon.features("scum x x")[1] > 0
    begins = frozenset(lexicon.weights)
    assert toxicity.phrases_of("a trashy b scum".split(), begins) == {" a trashy ", " trashy b ", " b scum "}
    assert toxicity.phrases_of(["trash"], begins) == toxicity.phrases_of([], begins) == set()


def test_exception_phrases_are_learned(spark):
    """An insult that is also half of a harmless phrase."""
    draw, rows, labels = random.Random(5), [], []
    for i in range(1200):
        words = [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.choice('klmnp')}" for _ in range(30)]
        at, kind = draw.randrange(28), i % 8
        if kind < 3:
            words[at : at + 2] = [draw.choice(["grobian", "flegel"]), "du"]
        elif i % 32 == 3:
            words[at : at + 2] = ["flegel", "drusch"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lexicon.exceptions == {f" {' '.join(folded_words('flegel drusch'))} "}
    assert lexicon.features("ein flegel drusch")[1] == 0 < lexicon.features("ein flegel")[1]


def labelled(spark, n):
    draw = random.Random(2)
    bad, fine = ["grobian", "flegel", "dummkopf"], [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(fine) for _ in range(draw.choice([5, 40, 400]))]
        toxic = i % 4 == 0
        for _ in range(max(2, len(words) // 20) if toxic else 0):
            words[draw.randrange(len(words))] = draw.choice(bad) + draw.choice(["", "!", "s"])
        docs.append((i, " ".join(words), "de", "s", 0.5))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark, 900)
    lexicon = toxicity.learn(docs, labels, train=~held_out(F.col("doc_id")))
    rows = toxicity.score_toxicity(docs, lexicon).withColumn("out", held_out(F.col("doc_id"))).collect()
    out = [r for r in rows if r["out"]]
    assert len(out) > 100
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in out]) > 0.97
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["score"] < 0.3}


@pytest.mark.parametrize("train_rows", [200, 8000])
def test_scores_keep_the_balance_when_one_label_is_cut(spark, train_rows):
    draw = random.Random(4)
    fine = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(2000):
        words, toxic = draw.choices(fine, k=20), i % 10 == 0
        if toxic or draw.random() < 0.1:
            words[7] = "grobian"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), train_rows=train_rows)
    scores = [r["score"] for r in toxicity.score_toxicity(docs, lexicon).collect()]
    assert abs(np.mean(scores) - 0.1) < 0.03


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    train = ~held_out(F.col("doc_id"))
    assert toxicity.learn(docs, labels, train=train) == toxicity.learn(docs, flipped, train=train)


def test_toxicity_of_odd_tables(spark):
    docs, labels = labelled(spark, 40)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "flegel " * 20_000)], "doc_id long, text string")
    empty = labels.limit(0)
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 5), (3, 0), (3, 1)], "doc_id long, toxic int")
    for some in (empty, nulls):
        lexicon = toxicity.learn(docs, some)
        assert {r["score"] for r in toxicity.score_toxicity(odd, lexicon).collect()} == {0.5}
    lexicon = toxicity.learn(docs, labels)
    scores = toxicity.score_toxicity(odd, lexicon).collect()
    assert len(scores) == 3 and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score_toxicity(odd.limit(0), lexicon).count() == 0
