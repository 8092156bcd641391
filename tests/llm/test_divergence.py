"""Divergences against plain Python integers."""

import re
from collections import Counter

import pytest

from cohortwise.llm import divergence

LONG = "deep " * 300_000
ROWS = [
    ("alpha beta Beta x1y", "en", "a"), ("Alpha gamma, beta!", "en", "b"), ("alpha beta gamma", "en", None),
    ("ALPHA delta É é naïve", "en", "a"), ("é naïve é", "en", "c"), ("É naïve", "en", "c"), ("delta delta", "en", "b"),
    ("delta é", "en", "b"), (None, "en", "d"), ("", "en", "a"), ("solo words only here", "de", "a"), ("solo", "de", "b"),
    ("eins", "fr", "a"), ("no lang alpha", None, "a"), ("no lang beta", "", "b"), ("no more", None, None),
    (LONG, "en", "a"), ("deep deep", "en", "b"), ("deep", "en", "c"), ("alpha beta gamma", "en", "b"),
    ("alpha beta gamma", "en", "b"),
]


def brute(rows, top):
    docs = [
        (lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for text, lang, source in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= 3)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def share(count, term):
            return 1 + 10**9 * (count[term] + 1) // (sum(count.values()) + len(kept))

        def value(p, q):
            return (p - q) ** 2 // q

        for s, count in counts.items():
            pairs = [(-sum(value(share(count, t), share(c, t)) for t in kept), o) for o, c in counts.items() if o != s]
            terms = [
                (-value(share(count, t), share(whole, t)), t) for t in kept
                if count[t] and share(count, t) > share(whole, t)
            ]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(
    ("top", "cells", "terms", "sources"), [(200, 500_000, 20_000, 256), (2, 1, 1, 1), (3, 7, 2, 2), (1, 100, 50, 3)]
)
def test_matches_plain_integers(spark, top, cells, terms, sources):
    rows = [(*r, 5, "s") for r in ROWS]
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term int, sources string").repartition(4)
    stripes = divergence.stripes_of(docs, max_cells=cells)
    found = divergence.divergences(stripes, top, terms_per_unit=terms, sources_per_unit=sources)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(ROWS, top)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergences(docs).collect() == []


def test_long_division_is_exact():
    import numpy as np

    total = 9 * 10**15 - 1
    counts = [0, 1, 12345678901, 10**14, total - 1, total // 3]
    got = divergence.shares(np.array(counts, np.int64), np.int64(total))
    assert got.tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_long_texts_are_folded_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "_TEXT_BYTES", 3)
    numbers = divergence._Numbers()
    ids, counts = divergence.term_counts(b"aa bbbbbb Aa c1c \xc3\xa9", numbers)
    names = list(numbers)
    found = {names[i]: n for i, n in zip(ids.tolist(), counts.tolist(), strict=True)}
    assert found == {b"aa": 2, b"bbbbbb": 1, b"c": 2, b"\xc3\xa9": 1}
    assert len(divergence.term_counts(b"", numbers)[0]) == 0 == len(divergence.term_counts(b"1 2", numbers)[0])
