"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors are scaled to length one and rounded to int8 with one scale each. The length of
each vector's rounding error is known, so the product of two rounded vectors bounds
their cosine from both sides. Tiles of vectors are multiplied pair by pair; only pairs whose
bounds lie on both sides of the threshold are computed again in double precision.
Tiles are stored once. Bands of them, of a fixed size in bytes, go round one after
another to tasks that pass over the stored tiles, so no tile is copied for each other tile.
A band returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.components import components
from cohortwise.llm.vectors import doubles, is_finite
from cohortwise.session import stored

_BLOCK = 256  # rows of a tile multiplied at once
_PART = 1 << 18  # pairs counted and tied at once, at least if there are as many
_EXACT = 1000  # components whose int8 products add up exactly in single precision
_SLACK = 1e-9  # rounding of the bounds themselves, far above that of a double
_HELD = 1 << 20  # rows from bands, besides two for each vector, that are kept before they are folded


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component goes first, so squares can't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tile:
    """Vectors with the int8 form, scales and error lengths of their unit vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        unit = self.unit(slice(None))
        self.scale = np.abs(unit).max(axis=1) / 127.0
        self.rounded = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.rounded * self.scale[:, None]
        self.error = np.sqrt(((unit - near) ** 2).sum(axis=1))
        self.length = np.sqrt((near**2).sum(axis=1))

    def __len__(self) -> int:
        return len(self.vectors)

    def unit(self, rows: np.ndarray | slice) -> np.ndarray:
        """Unit vectors in double precision, made when asked for."""
        return unit_rows(self.vectors[rows].astype(np.float64))


def int_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows held in single precision, where they are exact."""
    if x.shape[1] <= _EXACT:
        return x @ y.T
    parts = range(0, x.shape[1], _EXACT)
    return sum((x[:, i : i + _EXACT] @ y[:, i : i + _EXACT].T).astype(np.float64) for i in parts)


def linked_pairs(x: Tile, y: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) with a cosine of at least ``threshold``, block by block."""
    top_scale, top_length, top_error = y.scale.max(), y.length.max(), y.error.max()
    single = y.rounded.astype(np.float32)
    for begin in range(0, len(x), _BLOCK):
        part = slice(begin, begin + _BLOCK)
        product = int_product(x.rounded[part].astype(np.float32), single)
        # A bound per row of x first: below it no vector of y can reach the threshold.
        loose = x.error[part] * top_length + x.length[part] * top_error + x.error[part] * top_error
        least = (threshold - loose - _SLACK) / (x.scale[part] * top_scale)
        least = (least * (1 - 1e-6) - 1).astype(np.float32)
        rows = np.flatnonzero(product.max(axis=1) >= least)
        product = product[rows]
        i, j = np.divmod(np.flatnonzero((product >= least[rows, None]).ravel()), len(y))
        near = product[i, j].astype(np.float64)
        i = rows[i] + begin
        near *= x.scale[i] * y.scale[j]
        bound = x.error[i] * y.length[j] + x.length[i] * y.error[j] + x.error[i] * y.error[j] + _SLACK
        sure = near - bound >= threshold
        open_ = np.flatnonzero(~sure & (near + bound >= threshold))
        exact = np.empty(len(open_))
        for k in range(0, len(open_), 1 << 14):  # bounds the memory of the two gathers
            some = open_[k : k + (1 << 14)]
            exact[k : k + len(some)] = np.einsum("ij,ij->i", x.unit(i[some]), y.unit(j[some]))
        sure[open_[exact >= threshold]] = True
        yield i[sure], j[sure]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For every one of n nodes the smallest node it is linked with over the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for u, v in pairs:
            least = np.minimum(label[u], label[v])
            np.minimum.at(label, u, least)
            np.minimum.at(label, v, least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in fewer parts: whatever is found until there are _PART pairs or no more."""
    held = []
    for i, j in pairs:
        if len(i):
            held.append((i, j))
        if sum(len(x) for x, _ in held) >= _PART:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _spanning(n: int, u: np.ndarray, v: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than n pairs that link what the pairs (u, v) link; ``place`` maps nodes to larger numbers."""
    label = forest(n, [(u, v)])
    at = np.flatnonzero(label != np.arange(n))
    return place[at], place[label[at]]


class Band:
    """Tiles held by a task, with link counts and linked groups of their rows so far."""

    def __init__(self, tiles: Iterable[tuple], kind: str) -> None:
        self.kind, self.tiles, self.starts = kind, {}, {}
        ids, copies, size = [], [], 0
        for dims, place, *packed in tiles:
            its_ids, its_copies, tile = self.read(dims, *packed)
            self.tiles[dims, place], self.starts[dims, place] = tile, size
            ids.append(its_ids)
            copies.append(its_copies)
            size += len(tile)
        self.ids, self.copies = np.concatenate(ids), np.concatenate(copies)
        self.count, self.label = np.zeros(size, np.int64), np.arange(size)

    def read(self, dims: int, ids: bytes, copies: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, Tile]:
        values = np.frombuffer(vectors, self.kind).reshape(-1, dims)
        return np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), Tile(values)

    def meet(self, dims: int, place: int, packed: tuple, threshold: float) -> tuple[np.ndarray, ...]:
        """Link a tile with the tiles up to its own place; (ids, links, roots) of its rows if it isn't in the band."""
        inside, size = (dims, place) in self.tiles, len(self.ids)
        if inside:
            y, base = self.tiles[dims, place], self.starts[dims, place]
            ids, copies = (a[base : base + len(y)] for a in (self.ids, self.copies))
            count = self.count[base : base + len(y)]
        else:
            (ids, copies, y), base = self.read(dims, *packed), size
            count = np.zeros(len(ids), np.int64)
        ties, own = [], base + np.arange(len(y))
        for (its_dims, its_place), x in self.tiles.items():
            if its_dims != dims or its_place > place:
                continue
            start, same = self.starts[its_dims, its_place], its_place == place
            rows, counted = start + np.arange(len(x)), self.count[start : start + len(x)]
            for i, j in _gathered(linked_pairs(x, y, threshold)):
                if same:
                    i, j = i[i != j], j[i != j]
                    ties.append(_spanning(len(x), i, j, rows))
                else:
                    np.add.at(count, j, self.copies[start + i])
                    ties.append(_spanning(len(x) + len(y), i, j + len(x), np.concatenate([rows, own])))
                np.add.at(counted, i, copies[j])
        if ties:
            n = size if inside else size + len(y)
            before = np.flatnonzero(self.label != np.arange(size))
            u, v = (np.concatenate(side) for side in zip(*ties, (before, self.label[before]), strict=True))
            label = forest(n, [(u, v)])
            self.label = label[:size]
        if inside or not ties:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        linked = np.flatnonzero(count)
        # Every linked group has a row of the band, which comes before the tile's own.
        return ids[linked], count[linked], self.ids[label[size + linked]]

    def result(self) -> tuple[np.ndarray, ...]:
        linked = np.flatnonzero(self.count)
        return self.ids[linked], self.count[linked], self.ids[self.label[linked]]


_TILE = ["dims", "rows", "keys", "ids", "copies", "vectors"]
_PACKED = ["dims", "place", "ids", "copies", "vectors"]


def _tiles(classes: DataFrame, tile_rows: int, kind: str) -> DataFrame:
    """One row per tile: packed keys, ids, copies and vectors, and a place in the order of its dims."""

    def packed(dims: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        whole, values = (np.concatenate(x) for x in zip(*held, strict=True))
        columns = [np.ascontiguousarray(whole[:, :2]), whole[:, 2].copy(), whole[:, 3].copy(), values]
        head = [pa.array([dims], pa.int32()), pa.array([len(whole)], pa.int64())]
        return pa.RecordBatch.from_arrays([*head, *(pa.array([x.tobytes()], pa.binary()) for x in columns)], _TILE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            whole = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1)
            vectors = batch.column(4)
            sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                while len(rows):
                    some = held.setdefault(dims, [])
                    now, rows = np.split(rows, [tile_rows - sum(len(x) for x, _ in some)])
                    some.append((whole[now], flat[starts[now][:, None] + np.arange(dims)].astype(kind)))
                    if len(rows) or sum(len(x) for x, _ in some) == tile_rows:
                        yield packed(dims, held.pop(dims))
        for dims, some in held.items():
            yield packed(dims, some)

    tiles = classes.select("k1", "k2", "id", "n", "vector").mapInArrow(
        pack, "dims int, rows long, keys binary, ids binary, copies binary, vectors binary"
    )
    numbered = stored(tiles.withColumn("number", F.monotonically_increasing_id()))
    # First tiles of all tasks come first: what is left for later bands lies in all of them.
    place = F.col("number").bitwiseAND((1 << 33) - 1) * F.lit(1 << 31) + F.shiftright("number", 33)
    return numbered.withColumn("place", place)


def _classes(tiles: DataFrame) -> DataFrame:
    """(k1, k2, id, n) of every vector in the tiles."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                keys, ids, copies = (np.frombuffer(x.as_buffer(), np.int64) for x in row)
                parts = [keys[::2], keys[1::2], ids, copies]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["k1", "k2", "id", "n"])

    return tiles.select("keys", "ids", "copies").mapInArrow(unpack, "k1 long, k2 long, id long, n long")


def _bands(heads: list[tuple[int, int, int]], band_bytes: int, width: int) -> Iterator[tuple[Column, Column]]:
    """For every band of tiles, of ``band_bytes`` at most if of several, what is in it and what has to meet it.

    ``heads`` holds the dims, places and rows of all tiles, in order.
    """
    least = lambda dims, place: (F.col("dims") > dims) | ((F.col("dims") == dims) & (F.col("place") >= place))
    most = lambda dims, place: (F.col("dims") < dims) | ((F.col("dims") == dims) & (F.col("place") <= place))
    first, size = 0, 0
    for at, (dims, place, rows) in enumerate(heads):
        size += rows * (dims * width + 16)
        ends = at + 1 == len(heads)
        if ends or size + heads[at + 1][2] * (heads[at + 1][0] * width + 16) > band_bytes:
            begins = least(*heads[first][:2])
            yield begins & most(dims, place), begins & (F.col("dims") <= dims)
            first, size = at + 1, 0


def _links(band: Broadcast, kind: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, links, root) of rows linked between the band and the tiles of a task; root is another linked id or its own."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "links", "root"])
        held = None
        for batch in batches:
            for dims, place, *packed in zip(*batch.columns, strict=True):
                held = held or Band(band.value, kind)
                yield rows(held.meet(dims.as_py(), place.as_py(), [x.as_buffer() for x in packed], threshold))
        if held is not None:
            yield rows(held.result())

    return links


def _sent(tiles: DataFrame) -> Broadcast:
    rows = sorted(tuple(r) for r in tiles.select(_PACKED).collect())
    return tiles.sparkSession.sparkContext.broadcast(rows)


def _folded(found: DataFrame) -> DataFrame:
    """At most two rows for each id that say the same as ``found``: its links, and its component."""
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    ties = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return stored(
        counts.select("id", "links", F.lit(None).cast("long").alias("root"))
        .union(ties.select("node", F.lit(0).cast("long"), "component"))
    )


def _link_rows(tiles: DataFrame, threshold: float, kind: str, band_bytes: int) -> DataFrame:
    """(id, links, root) of linked rows, band by band; folded when there are more than the vectors."""
    spark = tiles.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism  # each reads the band once
    parts = [spark.range(0).select("id", F.col("id").alias("links"), F.col("id").alias("root"))]
    heads = sorted(tuple(r) for r in tiles.select("dims", "place", "rows").collect())
    size, vectors = 0, sum(rows for _, _, rows in heads)
    for inside, meets in _bands(heads, band_bytes, np.dtype(kind).itemsize):
        band = _sent(tiles.where(inside))
        found = tiles.where(meets).select(_PACKED).coalesce(tasks).mapInArrow(
            _links(band, kind, threshold), "id long, links long, root long"
        )
        parts.append(stored(found))
        band.destroy()
        size += parts[-1].count()
        if size > _HELD + 2 * vectors:
            parts, size = [_folded(reduce(DataFrame.union, parts))], 0
    return reduce(DataFrame.union, parts)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    tile_rows: int = 4096,
    band_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors are linked when their cosine in double precision is at least ``threshold``;
    n_links counts other rows linked directly, component_id is the smallest id reachable. Vectors
    that are null, of length zero, or hold null or non-finite components link with nothing, and so do vectors with
    different numbers of components. Equal vectors are compared once and counted as often
    as they occur. Rows without an id link with nothing, have no component and are kept.
    All pairs of tiles are compared, so the work grows with the square of the number of
    different vectors. The disk it takes grows with their number: vectors are shuffled once
    and stored once, as floats if they came so. A task holds a band of tiles of ``band_bytes``, which the
    driver fetches and sends out, and one tile more.
    """
    vector, usable = F.col("vector"), is_finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    plain = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind = "f4" if plain else "f8"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("vector"),
        (F.col(vector_col) if plain else doubles(F.col(vector_col))).alias("given"),
    ).withColumn("valid", F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull())
    keyed = rows.withColumns(
        {
            "k1": F.when(F.col("valid"), F.xxhash64(vector)),
            "k2": F.when(F.col("valid"), F.xxhash64(F.lit("second"), vector)),
        }
    )
    tiles = _tiles(
        keyed.where("valid").groupBy("k1", "k2").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("given").alias("vector")
        ),
        tile_rows, kind,
    )
    classes = _classes(tiles)
    found = _link_rows(tiles, threshold, kind, band_bytes)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    groups = (
        classes.select("k1", "k2", "id", "n").join(counts, "id", "left")
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "k1", "k2", F.coalesce("component", "id").alias("class_component"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("class_links"),
        )
    )
    joined = keyed.select("id", "k1", "k2").join(groups, ["k1", "k2"], "left")
    component = F.coalesce("class_component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
