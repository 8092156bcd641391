import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import digest, repeats
from cohortwise.llm import suffix_dedup
from cohortwise.llm.runlength_index import RunLengthIndex
from cohortwise.llm.suffix_dedup import dedup_substrings, drop_repeats


def statistics(texts):
    places = [(k, i) for k, t in enumerate(texts) for i in range(len(t) + 1)]
    out = []
    for k, i in places:
        best = 0
        for q, j in places:
            if (q, j) != (k, i):
                n = 0
                while n < min(len(texts[k]) - i, len(texts[q]) - j) and texts[k][i + n] == texts[q][j + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=8) | st.text("ab\0", max_size=9).map(str.encode), min_size=1, max_size=5))
def test_matching_statistics(texts):
    if any(texts):
        assert RunLengthIndex.build(texts).matching_statistics().tolist() == statistics(texts)


def test_runs_shrink_copies():
    draw = random.Random(0)
    text = bytes(draw.randrange(97, 123) for _ in range(3000))
    one, many = RunLengthIndex.build([text]), RunLengthIndex.build([text] * 20)
    assert len(many.lengths) < 1.1 * len(one.lengths) + 40
    assert many.lengths.sum() == 20 * 3001


def corpus(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (70, 90, 200, 350)]
    out = [None, "", "short", "aaa" * 200, "ab" * 400, "x" * 99, "x" * 100, shared[2], shared[2]]
    for _ in range(40):
        parts = [draw.choice(shared) if draw.random() < 0.4 else text(draw.randrange(150)) for _ in range(5)]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("group", [512, 1, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs_of, monkeypatch, group, seed):
    monkeypatch.setattr(suffix_dedup, "_GROUP", group)
    monkeypatch.setattr(suffix_dedup, "_INDEX_LETTERS", 3000)
    texts = corpus(seed)
    found = suffix_dedup.digest(dedup_substrings(docs_of(list(enumerate(texts))), length=100)).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in found}
    assert got == {i: digest(r) for i, r in enumerate(repeats(texts, 100))}


def test_long_text_is_cut_into_pieces_without_loss(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 37)
    draw = random.Random(3)
    text = bytes(draw.randrange(97, 100) for _ in range(900))
    whole = set()
    for _, first, last, _ in suffix_dedup.contexts(text, 80):
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            whole.update(range(a, b + 1))
    assert whole == set(range(len(text) - 79))


def test_null_ids_repeated_rows_and_all_columns(docs_of):
    long = "".join(chr(97 + i * i % 26) for i in range(150))
    rows = [(None, long), (1, long), (1, long), (2, None), (3, "é" * 10)]
    cut = drop_repeats(docs_of(rows), size_col="size", length=100)
    assert cut.columns == docs_of(rows).columns
    assert sorted((str(r["doc_id"]), r["text"], r["size"]) for r in cut.collect()) == [
        ("1", "", 0), ("1", "", 0), ("2", None, None), ("3", "é" * 10, 10), ("None", "", 0),
    ]
    assert dedup_substrings(docs_of([])).count() == 0


def test_drop_repeats_keeps_columns_of_any_name(spark):
    names = ["_null", "row", "others", "is_null", "kept", "z", "k1", "spans", "id", "a.b"]
    fields = ", ".join(["doc_id long", "text string", *[f"`{c}` long" for c in names]])
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [(i, t, *range(777, 777 + len(names))) for i, t in enumerate([long + "x", "y" + long, None, "", "short"])]
    got = sorted(suffix_dedup.drop_repeats(spark.createDataFrame(rows, fields), length=100).collect())
    assert [r["text"] for r in got] == ["x", "y", None, "", "short"]
    assert all(tuple(r)[2:] == tuple(range(777, 777 + len(names))) for r in got)
