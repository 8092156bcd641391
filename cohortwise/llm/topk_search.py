"""Exact top-k by inner product on a bit-sliced index.

Components are rounded to integers. A block of rows keeps one bitmap over its rows for each
bit of each component (its slices). A query's scores are made for all rows at once: slices
are added, shifted by the bits of the query's components, with bitmap arithmetic, which
gives the slices of the scores. The best rows are found from the most significant
score slice downward; rows that tie at the boundary are resolved by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.vectors import doubles, is_finite
from cohortwise.session import pinned

_MOST = float(1 << 40)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps (bit, component, word) of non-negative integers (row, component)."""
    rows, dims = values.shape
    bits = max(1, int(values.max()).bit_length())
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = values
    out = np.empty((bits, dims, len(padded) // 64), np.uint64)
    for bit in range(bits):
        one = np.ascontiguousarray(((padded >> bit) & 1).astype(np.uint8).T)
        out[bit] = np.packbits(one, axis=1, bitorder="little").view(np.uint64)
    return out


def add_slices(levels: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the sum of bitmaps, given as stacks of bitmaps for each power of two."""
    out: list[np.ndarray] = []
    level = 0
    while level in levels or level < max(levels, default=-1):
        stack = np.concatenate(levels.pop(level)) if level in levels else None
        while stack is not None and len(stack) > 1:
            # Carry-save adders: three bitmaps become a sum here and a carry above.
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            rest = stack[3 * third :]
            if third:
                both = a ^ b
                levels.setdefault(level + 1, []).append((a & b) | (c & both))
                stack = np.concatenate([both ^ c, rest])
            else:
                levels.setdefault(level + 1, []).append(rest[:1] & rest[1:])
                stack = rest[:1] ^ rest[1:]
        out.append(np.zeros(0, np.uint64) if stack is None else stack[0])
        level += 1
    return out


class SlicedBlock:
    """The index of one block; rows stand in the order of their ids."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray) -> None:
        self.ids, self.low, self.slices = ids, low, slices
        self.words = slices.shape[2]
        mask = np.zeros(self.words * 64, np.uint8)
        mask[: len(ids)] = 1
        self.rows = np.packbits(mask, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices, and what is to be added to the number they stand for."""
        bits = len(self.slices)
        size, negative = np.abs(query), query < 0
        # A negative factor multiplies the complement, so all that is added is positive.
        flip = np.where(negative, _ONES, np.uint64(0))[:, None]
        most = (1 << bits) - 1
        shift = sum(int(q) * int(x) for q, x in zip(query, self.low, strict=True))
        shift -= most * int(sum(int(x) for x in size[negative]))
        levels: dict[int, list[np.ndarray]] = {}
        for up in range(int(size.max()).bit_length()):
            dims = np.flatnonzero((size >> up) & 1)
            for bit in range(bits if len(dims) else 0):
                levels.setdefault(up + bit, []).append(self.slices[bit][dims] ^ flip[dims])
        empty = np.zeros(self.words, np.uint64)
        return [s if len(s) else empty for s in add_slices(levels)], shift

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but ``own``, ties to the smaller id."""
        score, shift = self.scores(query)
        open_, sure, n_sure = self.rows.copy(), np.zeros(self.words, np.uint64), 0
        for row in range(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")):
            open_[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        if int(np.bitwise_count(open_).sum()) > k:
            for plane in reversed(score):
                ones = open_ & plane
                n = int(np.bitwise_count(ones).sum())
                if n_sure + n >= k:
                    open_ = ones
                else:
                    sure, n_sure = sure | ones, n_sure + n
                    open_ = open_ & ~plane
        rows = np.concatenate([self._rows(sure), self._rows(open_)[: k - n_sure]])
        values = [0] * len(rows)
        for power, plane in enumerate(score):
            ones = (plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            for i in np.flatnonzero(ones):
                values[i] += 1 << power
        bound = (1 << 63) - 1
        return [
            (int(self.ids[r]), max(-bound, min(bound, v + shift)))
            for r, v in zip(rows, values, strict=True)
        ]

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """One row per block: packed ids, smallest components and slices."""
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("rows"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows))
    placed = rows.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("id", "x"), blocks))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        values = np.stack(pdf["x"].to_numpy()).astype(np.int64)
        low = values.min(axis=0)
        slices = slices_of(values - low)
        packed = [x.tobytes() for x in (pdf["id"].to_numpy(np.int64), low, slices)]
        head = [int(pdf["dims"].iloc[0]), slices.shape[0]]
        return pd.DataFrame([[*head, *packed]], columns=["dims", "bits", "ids", "low", "slices"])

    schema = "dims int, bits int, ids binary, low binary, slices binary"
    return placed.groupBy("dims", "block").applyInPandas(build, schema)


def _query_blocks(queries: DataFrame, query_rows: int) -> DataFrame:
    sizes = queries.groupBy("dims").agg(F.count(F.lit(1)).alias("rows"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / query_rows))
    placed = queries.join(sizes, "dims").select(
        "dims", "id", "x", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "x"), blocks).alias("part")
    )
    return placed.groupBy("dims", "blocks", "part").agg(
        F.collect_list(F.struct("id", "x")).alias("queries")  # about query_rows of them
    )


def top_by_product(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    factor: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 16384,
    query_rows: int = 128,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query`` the k best other rows.

    Components x become floor(factor * x), x as double; the score is their integer inner product;
    ties go to the smaller id. Vectors that are null, empty, or hold null or non-finite components take no part,
    and neither do rows without an id. Vectors are compared with those of as many components only. Rows
    equal in id and vector count once; a row's own id is never among its results.
    Components beyond 2^40 and scores beyond a long are clipped.
    """
    whole = F.transform(
        doubles(F.col(vector_col)),
        lambda x: F.floor(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), x * float(factor)))),
    )
    rows = pinned(
        vectors.where(is_finite(F.col(vector_col)) & F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
        .select(
            F.col(id_col).cast("long").alias("id"), whole.alias("x"), F.size(vector_col).alias("dims"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .distinct()
    )
    asked = _query_blocks(rows.where("asks").select("id", "x", "dims"), query_rows)
    parts = asked.groupBy("dims").agg(F.max("blocks").alias("blocks"))
    index = _blocks(rows.select("id", "x", "dims"), block_rows).join(parts, "dims")
    meets = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = meets.join(asked.select("dims", "part", "queries"), ["dims", "part"]).select(
        "dims", "bits", "ids", "low", "slices", "queries"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, bits = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, low, slices = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                    for c, kind in ((2, np.int64), (3, np.int64), (4, np.uint64))
                )
                block = SlicedBlock(ids, low, slices.reshape(bits, dims, -1))
                found = [
                    (number, q["id"], vec, score)
                    for number, q in enumerate(batch.column(5)[i].as_py())
                    for vec, score in block.top(np.array(q["x"], np.int64), q["id"], k)
                ]
                hashed = [hash(tuple(q["x"])) for q in batch.column(5)[i].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([hashed[f[0]] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[3] for f in found], pa.int64()),
                    ],
                    ["query_id", "form", "vec_id", "score"],
                )

    near = pairs.mapInArrow(search, "query_id long, form long, vec_id long, score long")
    # k rows from each block for a query: its few best of every block, not its candidates.
    best = Window.partitionBy("query_id", "form").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
