"""Near-duplicate documents by one-permutation MinHash.

One hash per shingle is split into bins, the smallest of each bin is the
signature, and empty bins borrow from a bin drawn for them (optimal
densification), which keeps bins independent also for short texts. Bands of the
signature are bucket keys. Within a bucket every member is first tied to a few hub
members only, so a group of copies makes as many pairs as members and not their
square; every tie is then confirmed on the whole shingle sets. Members of crowded
buckets that this leaves in different components are compared exactly: they meet in
their rarest shingles, in few of the smaller set and a few more of the larger one,
and only where as many shingles follow as the two must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.components import components
from cohortwise.llm.texts import in_slices
from cohortwise.session import pinned

# Odd multipliers that mix 64-bit words.
_MIX_A, _MIX_B, _MIX_C = (
    np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
)
_PROBES = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_B
    x = (x ^ (x >> np.uint64(27))) * _MIX_C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` words.

    A-Z are lower-cased; words are separated by space and tab to carriage return. A
    text with fewer words is one shingle; without words the set is empty.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(hashed))
    out = np.full(len(hashed) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _MIX_A + hashed[i : i + len(out)])
    return np.unique(out)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Smallest hash of every bin; empty bins copy the first filled bin of a fixed draw."""
    # Bins are equal ranges of the hash, so the sorted set is already grouped by bin.
    at = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(at, prepend=np.uint64(bins)))
    filled = np.zeros(bins, bool)
    out = np.zeros(bins, np.uint64)
    filled[at[first]] = True
    out[at[first]] = shingles[first]
    own, empty = out.copy(), np.flatnonzero(~filled)
    if len(first) == 1:
        out[:] = shingles[0]
        return out
    start = 0
    while len(empty):
        steps = np.arange(start, start + _PROBES, dtype=np.uint64)[:, None]
        drawn = _mix(steps * _MIX_A + empty.astype(np.uint64) * _MIX_B + _MIX_C)
        drawn = (drawn % np.uint64(bins)).astype(np.int64)
        hits = filled[drawn]
        found = hits.any(axis=0)
        source = drawn[hits.argmax(axis=0), np.arange(len(empty))]
        out[empty[found]] = own[source[found]]
        empty, start = empty[~found], start + _PROBES
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band of ``rows`` bins; a key belongs to one band."""
    parts = sig.reshape(-1, rows)
    keys = np.arange(len(parts), dtype=np.uint64)
    for i in range(rows):
        keys = _mix(keys * _MIX_A + parts[:, i])
    return keys.view(np.int64)


def _set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketches(docs: DataFrame, words: int, bins: int, rows: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(
                        [band_keys(signature(s, bins), rows) if len(s) else None for s in sets],
                        pa.list_(pa.int64()),
                    ),
                ],
                ["id", "n_shingles", "set_id", "bands"],
            )

    return docs.mapInArrow(sketch, "id long, n_shingles long, set_id binary, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_set_id(s) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["set_id", "shingles"],
            )

    return docs.mapInArrow(hashes, "set_id binary, shingles array<long>")


def _as_edges(left: str, right: str) -> list:
    """Columns of one candidate pair: x and y, the smaller and larger set, and their ids a and b."""
    p, q = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    first = p("set_id") < q("set_id")
    return [
        F.least(p("set_id"), q("set_id")).alias("x"),
        F.greatest(p("set_id"), q("set_id")).alias("y"),
        F.when(first, p("id")).otherwise(q("id")).alias("a"),
        F.when(first, q("id")).otherwise(p("id")).alias("b"),
    ]


def _fit(left: str, right: str, percent: int):
    """Sets whose sizes differ too much cannot be similar enough."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, hubs) of the buckets with two members or more.

    The hubs are the member that meets the most others over all its buckets (the
    middle of a group of copies), the one with the smallest id, and one drawn by
    hash for this bucket.
    """
    bands = classes.select(F.struct("id", "n", "set_id").alias("m"), F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = pinned(bands.join(shared, "key"))
    degree = crowded.groupBy(F.col("m.set_id").alias("set_id")).agg(F.sum("size").alias("degree"))
    placed = crowded.withColumn("set_id", F.col("m.set_id")).join(degree, "set_id")
    hubs = placed.groupBy("key").agg(
        F.array_distinct(
            F.array(
                F.max(F.struct("degree", (-F.col("m.id")).alias("o"), "m"))["m"],
                F.min(F.struct(F.col("m.id").alias("o"), "m"))["m"],
                F.min(F.struct(F.xxhash64("key", "m.set_id").alias("o"), "m"))["m"],
            )
        ).alias("hubs")
    )
    return crowded, pinned(hubs)


def _star_edges(crowded: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs: in each bucket every member with the hubs."""
    ties = crowded.join(hubs, "key").select("m", F.explode("hubs").alias("hub"))
    fits = _fit("m", "hub", percent) & (F.col("m.set_id") != F.col("hub.set_id"))
    return ties.where(fits).select(*_as_edges("m", "hub")).distinct()


def _apart(crowded: DataFrame, hubs: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, n, set_id, component): the members of buckets that hold uncompared members of two components."""
    # Three members, of which two are no hubs, are the least; hubs are compared with all members.
    free = (
        crowded.where("size > 2").join(hubs, "key")
        .where("size > size(hubs) + 1")
        .where(~F.array_contains(F.col("hubs.set_id"), F.col("m.set_id")))
        .select("key", "m.id", "m.n", "m.set_id")
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    free = pinned(free)
    torn = free.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    torn = torn.where("low <> high").select("key")
    return free.join(torn, "key", "left_semi").select("id", "n", "set_id", "component").distinct()


def _rare_edges(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs: all members of different components that can be similar enough.

    Shingles are put in order of rarity. With J = ``percent`` / 100, sets of n <= m shingles that are similar enough share
    at least J / (1 + J) * (n + m), so the first one they share is among the first n - 2J / (1 + J) * n of the smaller set,
    one more counted, among the first m - J * m of the larger, and in both as many as they must share stand from there
    on. In a family that is not linked its common shingles come too late for the first of these, so they make no pairs.
    Shingles of one component only come first of all, as no wanted pair shares them.
    """
    tokens = apart.join(sets, "set_id").select(
        F.struct("id", "n", "set_id", "component").alias("m"), F.explode("shingles").alias("shingle")
    )
    spread = tokens.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("holders"),
        F.min("m.component").alias("low"), F.max("m.component").alias("high"),
    ).where("low <> high").select("shingle", "holders")
    common = tokens.join(spread, "shingle").groupBy("m").agg(
        F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("common")
    )
    n = F.col("m.n")
    least = F.ceil(n * percent / F.lit(100)).cast("int")
    rarest = F.slice("common", F.lit(1), F.size("common") - least + 1)
    rest = (F.size("common") - F.col("place")).cast("long")  # this shingle and those after it
    rare = pinned(
        common.where(F.size("common") >= least)
        .select("m", "common", F.posexplode(rarest).alias("place", "r"))
        .select("m", "r.shingle", rest.alias("rest"), (rest * (100 + percent) >= n * (2 * percent)).alias("early"))
    )
    # The largest component of a shingle's holders isn't compared with itself.
    held = rare.groupBy("shingle", "m.component").agg(F.count(F.lit(1)).alias("k"), F.max("early").alias("early"))
    held = held.groupBy("shingle").agg(
        F.max(F.struct("k", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("components"),
        F.max("early").alias("early"),
    ).where("components > 1 and early").select("shingle", "main")
    others = pinned(
        rare.join(held, "shingle").where("m.component <> main")
        .select("shingle", F.col("m").alias("o"), F.col("rest").alias("o_rest"), F.col("early").alias("o_early"))
    )
    smaller = F.struct("o.n", "o.set_id") < F.struct("m.n", "m.set_id")
    shared = F.least("rest", "o_rest") * (100 + percent) >= (F.col("o.n") + n) * percent
    met = others.join(rare, "shingle").where(
        (F.col("o.component") != F.col("m.component")) & _fit("o", "m", percent) & shared
        & F.when(smaller, F.col("o_early")).otherwise(F.col("early"))
    )
    return met.select(*_as_edges("o", "m")).distinct()


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the candidate pairs whose whole sets are similar enough."""
    paired = (
        edges.join(sets.toDF("x", "left"), "x")
        .join(sets.toDF("y", "right"), "y")
        .withColumn("common", F.size(F.array_intersect("left", "right")))
        .withColumn("both", F.size("left") + F.size("right") - F.col("common"))
    )
    return paired.where(F.col("common") * 100 >= F.col("both") * percent).select("a", "b")


def _joined(linked: DataFrame, links: DataFrame) -> DataFrame:
    """``linked`` after its components, and nodes that have none yet, are joined by ``links``."""
    # A component is named by its smallest node, so joined components are named by the smallest of their names.
    name = linked.toDF("id", "name")
    for end in ("a", "b"):
        links = links.join(name, F.col(end) == F.col("id"), "left").withColumn(end, F.coalesce("name", end)).select("a", "b")
    joined = components(links).toDF("component", "larger")
    every = linked.unionByName(joined.select(F.col("component").alias("node"), "component")).distinct()
    # A joined node that had no link before names itself; one that had is in both lists with the same name.
    return pinned(every.join(joined, "component", "left").select("node", F.coalesce("larger", "component").alias("component")))


def _linked(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with others."""

    def sets_of(ids: DataFrame) -> DataFrame:
        return pinned(_sets(texts.join(ids, "id", "left_semi"), words).dropDuplicates(["set_id"]))

    crowded, hubs = _buckets(classes)
    edges = pinned(_star_edges(crowded, hubs, percent))
    sets = sets_of(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct())
    linked = components(_confirmed(edges, sets, percent))
    apart = pinned(_apart(crowded, hubs, linked))
    if apart.isEmpty():
        return linked
    sets = sets_of(apart.select("id").distinct())
    links = pinned(_confirmed(_rare_edges(apart, sets, percent), sets, percent))
    return linked if links.isEmpty() else _joined(linked, links)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bins: int = 160,
    rows: int = 5,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents whose shingle sets share at least ``percent`` hundredths of their union are
    linked; component_id is the smallest id reachable, kept marks it. Texts without
    words link with nothing. Rows with equal sets form one class and enter the
    search once. A row without an id is linked with nothing, has no component and
    is kept. Rows that share an id but not their text are judged by their text.
    With 32 bands of 5 bins a pair at 0.8 shares no bucket with probability 3e-6; a pair that shares one
    is compared, unless other links tie it already.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = pinned(_sketches(texts, words, bins, rows))
    classes = (
        sketches.where("set_id is not null and id is not null")
        .groupBy("set_id")
        .agg(F.min(F.struct("id", F.col("n_shingles").alias("n"), "bands")).alias("c"))
        .select("set_id", "c.*")
    )
    linked = _linked(texts, classes, words, percent)
    groups = classes.select("set_id", F.col("id").alias("node")).join(linked, "node", "left")
    groups = groups.select("set_id", F.coalesce("component", "node").alias("class_id"))
    found = F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return (
        sketches.drop("bands").join(groups, "set_id", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), found))
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates of smaller ids.

    Of rows that share an id one stays, the one with the smallest hash of its columns.
    Rows without an id stay. Options are those of ``near_duplicates``.
    """
    found = near_duplicates(docs, id_col=id_col, **options)
    kept = found.where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    rows = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi")
    one = rows.groupBy(F.col(id_col).alias("_id")).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    )
    return one.select("_row.*").unionByName(docs.where(F.col(id_col).isNull()))
