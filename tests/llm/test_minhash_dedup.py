import random

import numpy as np
import pytest

from brute import near_duplicates as brute
from brute import shingles
from cohortwise.llm.components import components
from cohortwise.llm.minhash_dedup import (
    _rare_edges, drop_near_duplicates, near_duplicates, shingle_set, signature,
)

ROWS = [
    (1, "a b c d e f g h i j"), (2, "A B  C\td e f g h i j"), (3, None), (4, ""), (5, " \n "),
    (6, "one two"), (7, "ONE two"), (8, "two one"), (9, "x " * 50), (10, "É a b c"), (11, "é a b c"),
    (12, "w\x0bv\x0cu t s\rr"), (13, "w v u t s r"),
]


def varied(seed, size, groups):
    draw, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{draw.randrange(300)}" for _ in range(draw.choice([3, 8, 30, 120]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = f"z{draw.randrange(50)}"
            out.append((len(out) * 3 + g, " ".join(copy)))
    return out


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("words", [4, 5])
@pytest.mark.parametrize("rows", [ROWS, varied(1, 8, 12), varied(2, 40, 2)])
def test_equals_brute_force(docs_of, words, rows):
    found = near_duplicates(docs_of(rows), words=words)
    assert as_dict(found) == brute(rows, words, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_a_middle_text_links_copies_that_are_far_from_each_other(docs_of):
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for k in (i * 3, i * 3 + 1, (i * 7) % 200, (i * 11 + 5) % 200):
            copy[k] = f"z{i}"
        rows.append((i, " ".join(copy)))
    assert as_dict(near_duplicates(docs_of(rows), words=4)) == brute(rows, 4, 80)


def family(seed, size, pairs):
    """Texts on one template, similar by 0.7, some of them with a copy similar by 0.83."""
    draw = random.Random(seed)
    template, rows = [f"t{i}" for i in range(100)], []
    for i in range(size):
        own = [f"o{i}x{k}" for k in range(20)]
        rows.append(template + own)
        if i < pairs:
            rows.append(template + own[:9] + [f"c{i}x{k}" for k in range(11)])
    draw.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_copies_inside_a_family_are_found(docs_of):
    rows = family(1, 400, 40)
    want = brute(rows, 4, 80)
    assert sum(i != c for i, (_, c) in want.items()) == 40
    assert as_dict(near_duplicates(docs_of(rows), words=4)) == want


def rare_edges(spark, sets, percent, component=lambda i: i):
    """Pairs of places in ``sets`` that are to be compared."""
    names = [f"{(i * 7919) % 100_003:06d}".encode() for i in range(len(sets))]
    apart = [(i, len(s), bytearray(names[i]), component(i)) for i, s in enumerate(sets)]
    edges = _rare_edges(
        spark.createDataFrame(apart, "id long, n long, set_id binary, component long"),
        spark.createDataFrame([(bytearray(n), sorted(s)) for n, s in zip(names, sets, strict=True)], "set_id binary, shingles array<long>"),
        percent,
    ).collect()
    assert all(bytes(r["x"]) == names[r["a"]] and bytes(r["y"]) == names[r["b"]] and r["x"] < r["y"] for r in edges)
    return {tuple(sorted((r["a"], r["b"]))) for r in edges}


def similar(sets, percent):
    return {
        (i, j) for j in range(len(sets)) for i in range(j)
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    }


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("parts", [1, 4])
def test_no_similar_pair_of_different_components_is_left_out(spark, percent, parts):
    draw, sets = random.Random(percent), []
    for _ in range(12):
        base = draw.sample(range(200), draw.choice([4, 9, 20, 60, 100]))
        for _ in range(8):
            kept = draw.sample(base, len(base) - draw.randrange(draw.choice([2, len(base) // 4 + 1])))
            sets.append(set(kept) | set(draw.sample(range(200), draw.randrange(draw.choice([2, len(base) // 6 + 1])))))
    sets = [set(s) for s in dict.fromkeys(map(frozenset, sets))]
    component = (lambda i: i) if parts == 1 else (lambda i: i % parts)
    want = {(i, j) for i, j in similar(sets, percent) if component(i) != component(j)}
    assert want and want <= rare_edges(spark, sets, percent, component)


def test_a_family_makes_no_square_of_pairs(spark):
    sets = [set(map(int, shingle_set(text, 4).view(np.int64))) for _, text in family(1, 300, 15)]
    found, want = rare_edges(spark, sets, 80), similar(sets, 80)
    assert len(want) == 15 and want <= found and len(found) <= 2 * len(sets)


def test_null_ids_repeated_rows_and_clashing_names(docs_of):
    rows = [(1, "a b c d e")] * 3 + [(None, "a b c d e"), (None, None), (0, "a b c d e")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates(docs_of(rows)).collect())
    assert got == sorted([("1", "0", False)] * 3 + [("None", "None", True)] * 2 + [("0", "0", True)])
    kept = drop_near_duplicates(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "None", "None"]
    again = drop_near_duplicates(docs_of([(1, "a b c d e")] * 3))
    assert again.count() == 1


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_shingles_and_signature():
    for text in ("", None, "a", "a b c d", "a b a b a b a b", "x" * 100_000):
        assert len(shingle_set(text, 4)) == len(shingles(text, 4))
    rng = np.random.default_rng(0)
    same = []
    for _ in range(300):  # sets of five, of which four are shared: similarity 4 / 6
        x = np.unique(rng.integers(0, 2**63, 6, dtype=np.uint64))
        same.append((signature(np.sort(x[:5]), 160) == signature(np.sort(x[1:]), 160)).mean())
    assert abs(np.mean(same) - 4 / 6) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (None, 3), (300, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
