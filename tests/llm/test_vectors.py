import os
import random
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import best_products, linked_vectors
from cohortwise.llm import embedding_dedup
from cohortwise.llm.embedding_dedup import Tile, forest, linked_pairs, near_vectors, unit_rows
from cohortwise.llm.topk_search import SlicedBlock, add_slices, slices_of, top_by_product

SCHEMA = "vec_id long, embedding array<float>, label int, dims int, id string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(
        [(i, v, 0, 0, "") for i, v in rows], SCHEMA.replace("float", kind)
    )


def clustered(seed, n, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dims) * rng.choice([0.0, 0.1, 0.25, 0.4, 2.0])
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


ODD = [
    (1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0, None] * 6), (1004, [float("nan")] * 12),
    (1005, [float("inf")] * 12), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [-1.0, -2.0]), (1009, [1e30] * 12), (1010, [1e-30] * 12),
]


@pytest.mark.parametrize("tile_rows", [16, 4096])
@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_links_equal_brute_force(spark, tile_rows, threshold):
    rows = clustered(1, 150) + ODD
    found = near_vectors(frame(spark, rows), threshold=threshold, tile_rows=tile_rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == linked_vectors(rows, threshold)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("held", [1 << 20, -(1 << 20)])
def test_bands_one_by_one_and_folded(spark, monkeypatch, kind, held):
    monkeypatch.setattr(embedding_dedup, "_HELD", held)
    rows = clustered(4, 90) + ODD
    found = near_vectors(frame(spark, rows, kind), threshold=0.8, tile_rows=7, band_bytes=2000).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == linked_vectors(rows, 0.8)


def test_disk_grows_with_the_vectors_not_with_their_tiles(spark):
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    df = frame(spark, clustered(6, 1600, 128)).localCheckpoint()

    def held():
        sizes = 0
        for folder in folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    try:
                        sizes += os.stat(f"{at}/{name}").st_size
                    except OSError:  # gone meanwhile
                        pass
        return sizes

    before, most, over = held(), 0, threading.Event()

    def watch():
        nonlocal most
        while not over.wait(0.02):
            most = max(most, held())

    watcher = threading.Thread(target=watch)
    watcher.start()
    found = near_vectors(df, tile_rows=64).count()
    over.set()
    watcher.join()
    # 800 kB of floats; over 20 MB if each tile is sent to all others.
    assert found == 1600 and max(most, held()) - before < 4e6


def test_copies_null_ids_and_no_rows(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(5, v), (3, v), (9, v), (9, v), (4, w), (None, v), (None, None)]
    got = Counter(tuple(r) for r in near_vectors(frame(spark, rows, "double")).collect())
    assert got == Counter(
        [(5, 3, 3, False), (3, 3, 3, True), (9, 3, 3, False), (9, 3, 3, False), (4, 0, 4, True), (None, 0, None, True), (None, 0, None, True)]
    )
    assert near_vectors(frame(spark, [])).count() == 0


def test_bounds_hold_and_decide():
    rng = np.random.default_rng(3)
    unit = unit_rows(rng.normal(size=(300, 1500)) + 2 * rng.normal(size=1500))
    tile = Tile(unit)
    near = (tile.rounded * tile.scale[:, None]) @ (tile.rounded * tile.scale[:, None]).T
    exact = unit @ unit.T
    bound = np.outer(tile.error, tile.length) + np.outer(tile.length, tile.error) + np.outer(tile.error, tile.error)
    assert (np.abs(near - exact) <= bound + 1e-12).all()
    for threshold in (0.78, 0.8, 0.82):
        pairs = {(int(i), int(j)) for a, b in linked_pairs(tile, tile, threshold) for i, j in zip(a, b, strict=True)}
        assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(exact >= threshold), strict=True)}


def test_forest():
    draw = random.Random(1)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    label = forest(60, [(np.array([a]), np.array([b])) for a, b in pairs])
    want = list(range(60))
    for _ in range(60):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert label.tolist() == want


@pytest.mark.parametrize("block_rows,query_rows", [(8, 3), (16384, 128)])
@pytest.mark.parametrize("k", [1, 5, 20])
def test_top_equals_brute_force(spark, block_rows, query_rows, k):
    rng = np.random.default_rng(7)
    rows = clustered(2, 120) + [(i, [float(x) for x in rng.integers(-1, 2, 12)]) for i in range(200, 290)]
    rows += [r for r in ODD if r[0] != 1009]
    found = top_by_product(
        frame(spark, rows), F.col("vec_id") % 20 == 0, k=k, block_rows=block_rows, query_rows=query_rows
    ).collect()
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == best_products(rows, lambda i: i % 20 == 0, k, 64)


def test_top_of_few_repeated_large_or_no_rows(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [9.0, 9.0]), (3, [1e300, 0.0])]
    got = top_by_product(frame(spark, rows, "double"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3), (2, 1), (3, 2)]
    assert top_by_product(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert top_by_product(frame(spark, rows, "double"), F.col("vec_id") == 77).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(5)
    for dims, rows, most in ((1, 5, 1), (7, 130, 9), (64, 300, 127)):
        values = rng.integers(0, most + 1, (rows, dims))
        slices = slices_of(values)
        total = add_slices({b: [slices[b]] for b in range(len(slices))})
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:rows] if len(s) else np.zeros(rows) for s in total]
        assert (sum((b.astype(np.int64) << i) for i, b in enumerate(bits)) == values.sum(axis=1)).all()
        query = rng.integers(-50, 51, dims)
        block = SlicedBlock(np.arange(rows), values.min(axis=0), slices_of(values - values.min(axis=0)))
        want = sorted((-int(s), i) for i, s in enumerate(values @ query) if i != 3)[:4]
        assert sorted(block.top(query, 3, 4), key=lambda r: (-r[1], r[0])) == [(i, -s) for s, i in want]
