"""Best-fit packing of documents into bins of words, with conflicts.

Documents are dealt to shards of about equal row counts by hash. A shard's bins are
ordered by the room left; each bin carries bitmaps of its sources and duplicate
clusters. A document goes to the tightest bin that holds it and none of its
conflicts: the search starts at the first bin with enough room and goes on to the
next larger one until a compatible bin is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEMA = (
    "id long, copy long, size long, piece long, first_word long, n_words long, bin_id long, "
    "bin_offset long"
)


class Bins:
    """Open bins of one shard, ordered by (room, number)."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.count = 0
        self._order: list[tuple[int, int]] = []
        #: Bitmaps per bin: clusters, then sources seen once, twice, and so on.
        self._clusters: dict[int, int] = {}
        self._sources: dict[int, list[int]] = {}

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest compatible bin, a new one if there is none."""
        source_bit, cluster_bit = 1 << source, 1 << cluster
        for at in range(bisect_left(self._order, (size, -1)), len(self._order)):
            room, number = self._order[at]
            if not (self._clusters[number] & cluster_bit or self._sources[number][-1] & source_bit):
                del self._order[at]
                break
        else:
            room, number = self.capacity, self.count
            self.count += 1
            self._clusters[number], self._sources[number] = 0, [0] * self.per_source
        self._clusters[number] |= cluster_bit
        planes = self._sources[number]
        for i, plane in enumerate(planes):
            planes[i] = plane | source_bit
            if not plane & source_bit:
                break
        if room > size:
            insort(self._order, (room - size, number))
        else:
            del self._clusters[number], self._sources[number]
        return number, self.capacity - room

    def full(self) -> int:
        """A bin that one piece fills."""
        self.count += 1
        return self.count - 1


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> Iterator[tuple]:
    """Rows of the result for one shard; the longest documents are placed first."""
    bins, sources, clusters = Bins(capacity, per_source), {}, {}
    rows = rows.sort_values(
        ["size", "id", "copy", "source", "cluster"], ascending=[False, True, True, True, True],
        na_position="last", kind="stable",
    )
    ids = [None if pd.isna(x) else int(x) for x in rows["id"]]
    fields = zip(ids, rows["copy"], rows["size"], rows["source"], rows["cluster"], strict=True)
    for doc, copy, size, source, cluster in fields:
        whole, rest = divmod(size, capacity)
        for piece in range(whole):
            yield doc, copy, size, piece, piece * capacity, capacity, bins.full(), 0
        if rest:
            bit = sources.setdefault(source, len(sources))
            number, offset = bins.place(rest, bit, clusters.setdefault(cluster, len(clusters)))
            yield doc, copy, size, whole, whole * capacity, rest, number, offset


def numbered_copies(rows: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row per counted row: column ``n`` becomes ``copy`` from 0 to n - 1.

    Large counts are first cut into chunks, which are dealt out before they are expanded.
    """
    single = rows.where("n = 1").withColumn("copy", F.lit(0).cast("long")).drop("n")
    many = rows.where("n > 1").withColumn(
        "start", F.explode(F.expr(f"sequence(0L, n - 1, {chunk}L)"))
    )
    many = many.repartition("start", *[c for c in rows.columns if c != "n"]).withColumn(
        "copy", F.explode(F.expr(f"sequence(start, least(start + {chunk}L, n) - 1)"))
    )
    return single.unionByName(many.drop("n", "start"))


def pack(
    docs: DataFrame,
    size: Column,
    cluster: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    capacity: int = 2048,
    per_source: int = 2,
    shard_rows: int = 4096,
) -> DataFrame:
    """(id, copy, size, piece, first_word, n_words, bin_id, bin_offset), one row per piece.

    ``size`` counts a document's words, ``cluster`` names its group of copies. No bin holds
    more than ``capacity`` words, two documents of one cluster, or more than ``per_source``
    documents of one source. A document longer than a bin is cut: full pieces fill bins of their own, the
    rest is placed like a document. Documents without words get one row
    with null bin_id. Null sources are one source; documents with a null
    cluster are copies of each other. Equal rows are counted and numbered by ``copy``, so
    they spread over the shards. Bins are numbered shard * 2^32 + number in the shard; reruns agree.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("source"),
        F.coalesce(F.concat(F.lit("c"), cluster.cast("string")), F.lit("")).alias("cluster"),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
    )
    counted = plain.groupBy("id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    shards = max(1, round(docs.count() / shard_rows))
    rows = numbered_copies(counted)
    shard = F.pmod(F.xxhash64("id", "copy", "size", "cluster"), F.lit(shards))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(
            list(pack_shard(pdf, capacity, per_source)),
            columns=["id", "copy", "size", "piece", "first_word", "n_words", "bin_id", "bin_offset"],
        )
        out["id"] = pd.array(out["id"], dtype="Int64")
        out["bin_id"] += int(key[0]) << 32
        return out

    bins = rows.where("size > 0").groupBy(shard.alias("shard")).applyInPandas(packed, _SCHEMA)
    empty = rows.where("size = 0").select(
        "id", "copy", "size",
        *[F.lit(0).cast("long").alias(c) for c in ("piece", "first_word", "n_words")],
        *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset")],
    )
    return bins.unionByName(empty).withColumnRenamed("id", id_col)
