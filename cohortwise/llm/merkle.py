"""Merkle manifest of a dataset: leaves per group, group roots, one root, and proofs.

Rows are numbered inside their group by a range sort, which splits large groups. A tree level is a
fixed-offset window over that numbering: the row of a node's first leaf holds the node, lag and lead
at the level's distance bring its siblings, masked by the node's slot in its run and by the
run's length, and the first child of a run hashes the parent. Windows cover blocks of
about a thousand rows, the roots of the blocks are the rows of the next, smaller table, and
so on, so no group is ever in one task. Proofs are handed down again from table to table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.session import pinned

_BLOCK_ROWS = 1024
_ROW_BITS = 33  # monotonically_increasing_id: partition << 33 | row in partition


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' UTF-8 bytes."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*fields: Column) -> Column:
    """Digest of a row: each field ``-`` if null, else its byte count, ``:`` and its text."""

    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[part(f) for f in fields])


def group_key(group: Column) -> Column:
    """A string that sorts like the group's UTF-8 bytes, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the 0-based place within ``key`` along ``order``, and ``n``, the rows of the key.

    Equal rows differ by their place in the input alone, so that they are split as well.
    """
    turned = rows.withColumn("_turn", F.monotonically_increasing_id())
    along = ["key", *order, "_turn"]
    dealt = turned.repartitionByRange(*along).sortWithinPartitions(*along).drop("_turn")
    stored = pinned(dealt.withColumn("_at", F.monotonically_increasing_id()))
    split = stored.withColumns(
        {"_part": F.shiftright("_at", _ROW_BITS), "_row": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    )
    # One row per key and partition that holds it.
    spans = split.groupBy("key", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "key", "_part", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("key")).alias("n"),
    )
    return (
        split.join(spans, ["key", "_part"])
        .withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first"))
        .drop("_at", "_part", "_row", "_first", "_before")
    )


def _climbed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Add ``block``, ``top`` (the block's root, on its first row) and ``steps`` (each row's siblings).

    A step is a struct of the digests left and right of the row's node, joined; the last run of
    a level may leave both empty. Steps end where one node of the key is left.
    """
    block = "PARTITION BY key, block ORDER BY pos"
    carried = [*nodes.columns, "block"]
    rows = nodes.selectExpr(*nodes.columns, f"pos div {fanout**levels} AS block", "digest AS _node")
    for level in range(levels):
        reach = fanout**level
        run = reach * fanout
        # The node's place in its run, and how many nodes that run has.
        slot = f"pos % {run} div {reach}"
        length = f"least({fanout}, ceil((n - pos + pos % {run}) / {reach}))"
        lefts = [
            f"IF(pos % {reach} = 0 AND {slot} >= {j}, lag(_node, {j * reach}) OVER ({block}), NULL)"
            for j in range(fanout - 1, 0, -1)
        ]
        rights = [
            f"IF(pos % {reach} = 0 AND {slot} + {j} < {length}, lead(_node, {j * reach}) OVER ({block}), NULL)"
            for j in range(1, fanout)
        ]
        beside = rows.selectExpr(
            *carried, "_node",
            f"concat_ws('', {', '.join(lefts)}) AS left", f"concat_ws('', {', '.join(rights)}) AS right",
        )
        rows = beside.selectExpr(
            *carried,
            f"CASE WHEN pos % {run} <> 0 THEN NULL WHEN n > {reach} THEN sha2(concat(_node, right), 256) "
            "ELSE _node END AS _node",
            f"IF(pos % {reach} = 0 AND n > {reach}, struct(left, right), NULL) AS _step{level}",
        )
        carried.append(f"_step{level}")
    # The first row of a node lies at or before each of its leaves, later nodes lie after them.
    upto = f"OVER ({block} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    steps = [f"last(_step{level}, true) {upto}" for level in range(levels)]
    return rows.selectExpr(
        *nodes.columns, "block", "_node AS top", f"array_compact(array({', '.join(steps)})) AS steps"
    )


def tree(nodes: DataFrame, fanout: int = 2) -> DataFrame:
    """Add ``root``, the root of the row's key, and ``path``, the siblings from the row up to it.

    ``nodes`` has key, pos (0, 1, ... per key), n (rows of the key) and digest; other columns are
    kept. ``path`` is an array of (left, right), the digests beside each ancestor; a lone row's is empty.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = 1
    while fanout**levels < most and fanout ** (levels + 1) <= _BLOCK_ROWS:
        levels += 1
    span = fanout**levels
    if most <= 1:
        empty = F.array().cast("array<struct<left:string,right:string>>")
        return nodes.withColumns({"root": F.col("digest"), "path": empty})
    climbed = _climbed(nodes, fanout, levels)
    blocks = climbed.where(F.col("pos") % span == 0).select(
        "key", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("digest")
    )
    above = tree(pinned(blocks), fanout).select("key", F.col("pos").alias("block"), "root", F.col("path").alias("_up"))
    joined = climbed.join(above, ["key", "block"]).withColumn("path", F.concat("steps", "_up"))
    return joined.select(*nodes.columns, "root", "path")


def manifest(leaves: DataFrame, group: str, order: Sequence[str], fanout: int = 2) -> DataFrame:
    """Add ``subroot``, ``root`` and ``path`` to rows that have a ``leaf`` digest.

    Leaves of a group ascend by ``order`` (nulls first, then by digest) and every ``fanout`` consecutive ones
    become one node until one is left, the subroot; the last run may be shorter, a run of
    one is hashed as well. Subroots in the order of their groups (null first, bytewise) give the
    root in the same way. ``path`` runs from the leaf over its subroot to the root. Rows without a
    group are a group; equal rows are leaves of their own; an empty table gives no rows.
    """
    caller = F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row")
    keyed = leaves.select(group_key(F.col(group)).alias("key"), caller).withColumn("digest", F.col("row.leaf"))
    ordered = keyed.withColumns({f"_o{i}": F.col(f"row.`{c}`") for i, c in enumerate(order)})
    along = [f"_o{i}" for i in range(len(order))]
    groups = tree(numbered(ordered, [*along, "digest"]).drop(*along), fanout)
    tops = groups.where("pos = 0").select(
        F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("digest")
    )
    whole = tree(numbered(pinned(tops), ["group"]), fanout).select(
        F.col("group").alias("key"), F.col("root").alias("_root"), F.col("path").alias("_up")
    )
    joined = groups.join(pinned(whole), "key")
    found = {"subroot": F.col("root"), "root": F.col("_root"), "path": F.concat("path", "_up")}
    kept = [c for c in leaves.columns if c not in found]
    return joined.select(*[F.col(f"row.`{c}`") for c in kept], *[v.alias(k) for k, v in found.items()])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_of(path: Column) -> Column:
    """All siblings on a path, level by level, left to right, as one string of digests."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")
