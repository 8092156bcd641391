"""Remove byte strings that repeat, found with run-length compressed BWT indexes.

Every string of ``length`` bytes holds at least one anchor: the position whose
hash of 64 bytes is the smallest of the string. Equal strings have their anchor at
the same place, so all strings with one anchor hash meet in one index and no
index has to hold the corpus. A context is the stretch of text whose strings
have the same anchor position. Contexts of anchors that occur once can't repeat and are
dropped; the others are indexed, equal contexts at most twice, and the index's
matching statistics tell which of their strings start anywhere else.

An anchor with very many different contexts is split: strings are parted by where the
anchor stands in them, the first half and the second half, and the halves are grouped
by what all their strings have in common, again and again until a group is small. At the
last step a group's strings are all equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.runlength_index import RunLengthIndex
from cohortwise.llm.texts import in_slices
from cohortwise.session import pinned

# Odd multipliers that mix 64-bit words.
_MIX = [
    np.uint64(x)
    for x in (
        0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
        0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
    )
]
_ANCHOR = 64  # bytes under an anchor's hash; two to the number of multipliers
_PIECE = 1 << 22  # strings looked at together in a long text
_PLACE = np.uint64((1 << 24) - 1)
#: Letters after which an index is closed, and different contexts from which an anchor is split.
_INDEX_LETTERS, _GROUP = 200_000, 512
_OCCURRENCE = "k1 long, k2 long, start long, size int, at int, anchor long, context long"


def _byte_table() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


_TABLE = _byte_table()


def contexts(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, first string, last string, anchor position) of the contexts of a text."""
    for begin in range(0, len(text) - length + 1, _PIECE):
        piece = np.frombuffer(text, np.uint8)[begin : begin + _PIECE + length - 1]
        hashed, step = _TABLE[piece], 1
        for factor in _MIX:
            hashed = hashed[:-step] * factor + hashed[step:]
            hashed ^= hashed >> np.uint64(31)
            step *= 2
        # The place in the low bits makes the leftmost of equal hashes the smallest.
        least = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)
        window, step = length - _ANCHOR + 1, 1
        while step * 2 <= window:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        if window > step:
            least = np.minimum(least[: step - window], least[window - step :])
        place = (least & _PLACE).astype(np.int64)
        edge = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(place)]]) - 1
        yield hashed[place[first]].view(np.int64), begin + first, begin + last, begin + place[first]


def _text_key(text: bytes) -> tuple[int, int]:
    key = xxhash.xxh3_128_digest(text)
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


def _bytes(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in batch.column(column).cast(pa.binary()))


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            parts: list[tuple] = []
            for text in _bytes(batch, 0):
                if len(text) < length:
                    continue
                k1, k2 = _text_key(text)
                for anchor, first, last, place in contexts(text, length):
                    size = last - first + length
                    spans = zip(first.tolist(), (first + size).tolist(), strict=True)
                    context = np.fromiter(
                        (xxhash.xxh3_64_intdigest(text[a:b]) for a, b in spans), np.uint64, len(first)
                    ).view(np.int64)
                    keys = (np.full(len(first), k) for k in (k1, k2))
                    parts.append((*keys, first, size, place - first, anchor, context))
            if parts:
                kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
                columns = [
                    pa.array(np.concatenate(x).astype(kind))
                    for x, kind in zip(zip(*parts, strict=True), kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["k1", "k2", "start", "size", "at", "anchor", "context"]
                )

    return texts.select("text").mapInArrow(cut, _OCCURRENCE)


def _packed(texts: DataFrame) -> DataFrame:
    """(id, k1, k2, z): texts travel compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in in_slices(batches):
            texts = list(_bytes(batch, 1))
            keys = [_text_key(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([press.compress(t) for t in texts], pa.binary()),
                ],
                ["id", "k1", "k2", "z"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(pack, f"id {kind}, k1 long, k2 long, z binary")


def _unpacked(z: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z.as_py()) if z.is_valid else b""


def _with_bytes(distinct: DataFrame, packed: DataFrame) -> DataFrame:
    """(key, id, n, at, text) of contexts, cut from one text that holds them."""
    wanted = distinct.select(
        "rep.k1", "rep.k2", F.struct("key", "cid", "n", "rep.start", "rep.size", "rep.at").alias("c")
    ).groupBy("k1", "k2").agg(F.collect_list("c").alias("contexts"))
    sources = packed.groupBy("k1", "k2").agg(F.max("z").alias("z"))
    kinds = {"key": pa.int64(), "cid": pa.int64(), "n": pa.int64(), "at": pa.int32()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for z, asked in zip(batch.column(0), batch.column(1), strict=True):
                text, rows = _unpacked(z), asked.as_py()
                columns = [pa.array([r[c] for r in rows], k) for c, k in kinds.items()]
                cuts = [text[r["start"] : r["start"] + r["size"]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cuts, pa.binary())], [*kinds, "bytes"]
                )

    return sources.join(wanted, ["k1", "k2"]).select("z", "contexts").mapInArrow(
        cut, "key long, cid long, n long, at int, bytes binary"
    )


def _indexed(groups: DataFrame, length: int) -> DataFrame:
    """(key, cid, start, end) of what repeats in contexts; all of one key are in one partition."""

    def index(rows: list[tuple]) -> pa.RecordBatch:
        # A context that occurs more than once is there twice, which costs a longer run only.
        texts = [t for _, _, n, t in rows for _ in range(min(n, 2))]
        owner = np.repeat(np.arange(len(rows)), [min(n, 2) for _, _, n, _ in rows])
        text, start, end = RunLengthIndex.build(texts, length).long_matches(length)
        once = np.flatnonzero(np.diff(owner, prepend=-1)[text])
        row = owner[text[once]].tolist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in row], pa.int64()),
                pa.array([rows[i][1] for i in row], pa.int64()),
                pa.array(start[once]), pa.array(end[once]),
            ],
            ["key", "cid", "s", "e"],
        )

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        letters, key = 0, None
        for batch in in_slices(batches):
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if letters >= _INDEX_LETTERS and row[0] != key:
                    yield index(rows)
                    rows, letters = [], 0
                key = row[0]
                rows.append(row)
                letters += (len(row[3]) + 1) * min(row[2], 2)
        if rows:
            yield index(rows)

    return groups.mapInArrow(grouped, "key long, cid long, s long, e long")


def _halves(nodes: DataFrame, length: int) -> DataFrame:
    """Part the strings of every context in two by the distance of the anchor from their start."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(
        F.array(F.struct(F.col("lo").alias("l"), mid.alias("h")), F.struct((mid + 1).alias("l"), F.col("hi").alias("h")))
    )
    room = F.length("bytes") - length
    return (
        nodes.withColumn("half", half)
        .withColumns(
            {
                "far": F.least("half.h", "at"),
                "near": F.greatest(F.col("half.l"), F.col("at") - room),
                # What all strings of this half, however far the text goes on, have in common.
                "core": F.expr(f"substring(bytes, at - half.l + 1, {length} - (half.h - half.l))"),
            }
        )
        .where("near <= far")
        .select(
            "anchor", "context", "n",
            (F.col("off") + F.col("at") - F.col("far")).alias("off"),
            F.xxhash64("core", "half.l", "half.h").alias("key"),
            F.expr(f"substring(bytes, at - far + 1, far - near + {length})").alias("bytes"),
            F.col("far").cast("int").alias("at"), F.col("half.l").alias("lo"), F.col("half.h").alias("hi"),
        )
        .withColumn("cid", F.xxhash64("bytes"))
    )


def _split(nodes: DataFrame, length: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Small groups (key, cid, n, bytes) out of large ones, and where each part lies in its context."""
    groups, parts = None, None
    while True:
        nodes = pinned(_halves(nodes, length))
        distinct = nodes.groupBy("key", "cid").agg(
            F.sum("n").alias("n"), F.max("bytes").alias("bytes")
        )
        sizes = distinct.groupBy("key").agg(
            F.count(F.lit(1)).alias("different"), F.sum("n").alias("all")
        ).where("all > 1")
        small, large = sizes.where(f"different <= {_GROUP}"), sizes.where(f"different > {_GROUP}")
        ready = pinned(distinct.join(small, "key").select("key", "cid", "n", "bytes"))
        placed = nodes.join(small, "key", "left_semi").select("key", "cid", "anchor", "context", "off")
        groups = ready if groups is None else groups.unionByName(ready)
        parts = placed if parts is None else parts.unionByName(placed)
        nodes = pinned(nodes.join(large, "key", "left_semi"))
        if nodes.isEmpty():
            return groups, parts


def repeated_spans(texts: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spans): for each different text the stretches covered by repeated strings."""
    found = pinned(_occurrences(texts, length))
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = pinned(found.join(anchors, "anchor", "left_semi"))
    where = F.struct("k1", "k2", "start", "size", "at")
    distinct = shared.groupBy(F.col("anchor").alias("key"), F.col("context").alias("cid")).agg(
        F.count(F.lit(1)).alias("n"), F.min(where).alias("rep")
    )
    cut = pinned(_with_bytes(distinct, packed))
    sizes = cut.groupBy("key").agg(F.count(F.lit(1)).alias("different"))
    large = pinned(sizes.where(f"different > {_GROUP}"))
    groups, split = cut.select("key", "cid", "n", "bytes"), not large.isEmpty()
    if split:
        nodes = cut.join(large, "key", "left_semi").select(
            F.col("key").alias("anchor"), F.col("cid").alias("context"), "n",
            F.lit(0).cast("long").alias("off"), "bytes", "at",
            F.lit(0).alias("lo"), F.lit(length - _ANCHOR).alias("hi"),
        )
        more, parts = _split(nodes, length)
        groups = groups.join(large, "key", "left_anti").unionByName(more)
    spread = groups.repartition("key").sortWithinPartitions("key")
    marks = _indexed(spread, length)
    if split:
        marks = pinned(marks)
        inside = marks.join(parts, ["key", "cid"]).select(
            F.col("anchor").alias("key"), F.col("context").alias("cid"),
            (F.col("s") + F.col("off")).alias("s"), (F.col("e") + F.col("off")).alias("e"),
        )
        # Marks of whole contexts have no part; parts of a split context have one or more.
        marks = marks.join(parts, ["key", "cid"], "left_anti").unionByName(inside)
    hit = shared.join(marks.toDF("anchor", "context", "s", "e"), ["anchor", "context"])
    span = F.struct((F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    return hit.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400
) -> DataFrame:
    """(id, n_bytes, spans, kept): one row per row of ``docs``.

    ``spans`` are the maximal stretches (s, e) of the text's UTF-8 bytes covered by a
    string of ``length`` bytes that also starts anywhere else, in another row or in the same text;
    ``kept`` is what remains. Nulls are empty texts; texts shorter than ``length`` keep everything;
    equal rows repeat each other. Strings never cross rows. Other columns are not read.
    ``length`` is 64 or more. Texts are told apart by 128-bit hashes; anchors and contexts by 64 bits each.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    packed = _packed(texts)
    spans = repeated_spans(texts, packed, length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sizes, found, kept = [], [], []
            for z, asked in zip(batch.column(1), batch.column(2), strict=True):
                text, cuts = _unpacked(z), _union(asked.as_py())
                edges = [0, *(x for cut in cuts for x in cut), len(text)]
                sizes.append(len(text))
                found.append([{"s": s, "e": e} for s, e in cuts])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, span), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, spans array<struct<s: long, e: long>>, kept binary"
    joined = packed.join(spans, ["k1", "k2"], "left").select("id", "z", "spans")
    return joined.mapInArrow(remove, schema).withColumnRenamed("id", id_col)


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of the result of ``dedup_substrings``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return result.select(
        id_col, "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def drop_repeats(
    docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", length: int = 400
) -> DataFrame:
    """The rows of ``docs`` with what repeats cut out of their texts and ``size_col`` counted anew.

    A character of which a byte was cut goes whole. Null texts stay null.
    """
    others = [c for c in docs.columns if c != text_col]
    # The other columns go by number, in a struct of their own, so their names clash with none used here.
    beside = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(None).cast("string")
    rows = docs.select(
        F.struct(beside.alias("others"), F.col(f"`{text_col}`").isNull().alias("is_null")).alias("row"),
        F.col(f"`{text_col}`").alias("text"),
    )
    result = dedup_substrings(rows, "row", "text", length)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = [x.as_py().decode("utf-8", "ignore") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["row", "kept"]
            )

    kind = rows.schema["row"].dataType.simpleString()
    cut = result.select("row", "kept").mapInArrow(decode, f"row {kind}, kept string")
    text = F.when(~F.col("row.is_null"), F.col("kept"))
    columns = {c: F.col(f"row.others.c{i}") for i, c in enumerate(others)} | {text_col: text}
    if size_col in columns:
        columns[size_col] = F.length(text).cast(docs.schema[size_col].dataType)
    return cut.select(*[columns[c].alias(c) for c in docs.columns])
