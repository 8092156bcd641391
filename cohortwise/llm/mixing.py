"""Mix sources to target weights by Pareto order sampling.

Every document of a source first gets the whole copies that its target surely
holds. The rest of the target is a sample without replacement: documents are ranked
by their random odds u / (1 - u), divided by their inclusion odds p / (1 - p), and taken in
this order until the words are used up, so the size of the sample is fixed
though the chances differ. The order is cut into cells of about a thousand
documents; words are summed per cell, and only the cell in which the target ends
is looked at row by row, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.packing import numbered_copies

_LEAST_ODDS = 0.001
_U_DIGITS = 13


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
) -> DataFrame:
    """(source, source_size, target, ...) for every source of ``sizes``.

    ``sizes`` has source, words, weighed and units, one row per source. Sources in
    code point order, null last, weigh ``weights``, repeating, and share ``percent``
    hundredths of all words; no target exceeds ``most`` times its source's size, and what
    a full source leaves is shared by weight among the others.
    """
    # One row per source here, so these windows are as small as the list of sources.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ranked = sizes.withColumns(
        {
            "name_rank": F.row_number().over(by_name),
            "weight": weight,
            "cap": (F.col("words") * most).cast("double"),
            "total": F.sum("words").over(whole) * F.lit(percent) / F.lit(100.0),
        }
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "name_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level).withColumn(
        "is_full", F.col("cap") / F.col("weight") <= F.col("level")
    )
    share = F.max(F.when(~F.col("is_full"), F.col("level"))).over(whole)
    return levelled.select(
        "source", "units", "weighed",
        F.col("words").alias("source_size"),
        F.when(F.col("is_full"), F.col("cap")).otherwise(share * F.col("weight")).alias("target"),
    )


def _ranked(units: DataFrame, targets: DataFrame, cell_units: int) -> DataFrame:
    """Units with their source's numbers, their place in the Pareto order and its cell."""
    joined = units.join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = joined.withColumn("whole", F.floor(ratio))
    whole = whole.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size")))
    number = F.conv(F.substring(digest, 1, _U_DIGITS), 16, 10).cast("double")
    u = (number + 0.5) / float(16**_U_DIGITS)
    chance = F.col("rest") / F.col("source_size") * F.col("likely") / (
        F.col("weighed") / F.col("source_size")
    )
    p = F.least(F.greatest(F.coalesce(chance, F.lit(0.0)), F.lit(_LEAST_ODDS)), F.lit(1 - _LEAST_ODDS))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    cells = F.greatest(F.lit(1), F.ceil(F.col("units") / cell_units))
    return (
        whole.withColumns({"u": u, "p": p}).withColumn("odds", odds)
        .withColumn("cell", F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * cells), cells - 1))
        .drop("u", "p", "units", "weighed", "likely")
    )


def _taken_rows(ranked: DataFrame, fills: int) -> DataFrame:
    """Add ``extra``: how many of a unit's n rows the sample takes."""
    words = F.col("n") * F.col("size")
    cells = ranked.groupBy("source", "cell").agg(F.sum(words).alias("cell_words"), F.first("rest").alias("rest"))
    in_order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("cell_words").over(in_order), F.lit(0)))
    all_in = F.col("earlier") + F.col("cell_words") <= F.col("rest")
    cells = cells.select(
        F.col("source").alias("_source"), F.col("cell").alias("_cell"), "earlier",
        F.when(all_in, 2).when(F.col("earlier") < F.col("rest"), 1).otherwise(0).alias("part"),
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell"))
    placed = ranked.join(cells, same).drop("_source", "_cell")
    sure = placed.where("part <> 1").withColumn("extra", F.when(F.col("part") == 2, F.col("n")).otherwise(F.lit(0)))
    # A source has one cell in which its target ends: about cell_units rows of it come here.
    edge = placed.where("part = 1").withColumns(
        {"gap": F.col("rest") - F.col("earlier"), "extra": F.lit(0).cast("long")}
    )
    queue = Window.partitionBy("source").orderBy("skipped", "odds", "id", "size")
    ahead = queue.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    for step in range(fills + 1):
        # What still fits is taken in order; the last step rounds to the nearest word count.
        left = F.col("n") - F.col("extra")
        half = F.col("size") / 2.0 if step == fills else F.lit(0.0)
        edge = edge.withColumn("skipped", (left == 0) | (F.col("size") > F.col("gap") + half))
        edge = edge.withColumn(
            "_before", F.coalesce(F.sum(F.when(~F.col("skipped"), left * F.col("size"))).over(ahead), F.lit(0))
        )
        fit = F.floor((F.col("gap") - F.col("_before") + half) / F.col("size"))
        fit = F.when(F.col("size") == 0, left).otherwise(F.greatest(F.lit(0), F.least(left, fit)))
        # Once a unit doesn't fit whole, the step ends there.
        fit = F.when(F.col("skipped") | (F.col("_before") > F.col("gap")), F.lit(0)).otherwise(fit)
        edge = edge.withColumn("_fit", fit.cast("long"))
        edge = edge.withColumn("extra", F.col("extra") + F.col("_fit")).withColumn(
            "gap", F.col("gap") - F.sum(F.col("_fit") * F.col("size")).over(whole)
        )
    edge = edge.drop("gap", "skipped", "_before", "_fit")
    return sure.withColumn("extra", F.col("extra").cast("long")).unionByName(edge).drop("earlier", "part")


def allocate(
    docs: DataFrame,
    size: Column,
    likely: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    cell_units: int = 1000,
    fills: int = 3,
) -> DataFrame:
    """(id, source, size, n, source_size, target, whole, extra), one row per unit.

    A unit is all rows of one source that share id and size; ``n`` counts them. Each row of it is
    taken ``whole`` times and ``extra`` of its rows once more. ``likely`` weighs the inclusion
    chances inside a source (all alike by default). Null ids and null sources are values like
    others; sizes of null count 0. The draw hashes id and size, so reruns agree whatever the partitions.
    A source's taken words differ from its target by half a document near the end of the
    order at most, unless all its documents are larger than that.
    """
    plain = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
        F.coalesce(F.lit(1.0) if likely is None else likely.cast("double"), F.lit(1.0)).alias("likely"),
    )
    units = plain.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.max("likely").alias("likely"))
    words = F.col("n") * F.col("size")
    sizes = units.groupBy("source").agg(
        F.sum(words).alias("words"), F.sum(words * F.col("likely")).alias("weighed"), F.count(F.lit(1)).alias("units")
    )
    ranked = _ranked(units, source_targets(sizes, weights, percent, most), cell_units)
    return _taken_rows(ranked, fills).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col),
        "size", "n", "source_size", "target", "whole", "extra",
    )


def mix_report(units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of an allocation: id, size, source_size, target, taken words."""
    rows = numbered_copies(units)
    copies = F.col("whole") + F.when(F.col("copy") < F.col("extra"), 1).otherwise(0)
    return rows.select(id_col, "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame,
    size: Column,
    likely: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    **options,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    ``size`` and ``likely`` are expressions over ``docs``, whose columns may have any names. Rows of one unit
    are told apart by the order of a hash over all their columns. Other options are those of ``allocate``.
    """
    # Columns of docs stay inside one struct, so none of them can clash with the numbers beside it.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").alias("src"),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("words"),
        (F.lit(1.0) if likely is None else likely).cast("double").alias("likely"),
    )
    units = allocate(rows, F.col("words"), F.col("likely"), id_col="doc", source_col="src", **options)
    units = units.select(
        F.col("doc").alias("_doc"), F.col("src").alias("_src"), F.col("size").alias("_size"), "n", "whole", "extra"
    )
    joined = rows.drop("likely").join(
        units,
        F.col("doc").eqNullSafe(F.col("_doc")) & F.col("src").eqNullSafe(F.col("_src"))
        & (F.col("words") == F.col("_size")),
    )
    alone = joined.where("n = 1").withColumn("copies", F.col("whole") + F.col("extra"))
    # Only rows that share id, source and size need numbers.
    number = Window.partitionBy("doc", "src", "words").orderBy(F.xxhash64("row"))
    several = joined.where("n > 1").withColumn("at", F.row_number().over(number)).withColumn(
        "copies", F.col("whole") + F.when(F.col("at") <= F.col("extra"), 1).otherwise(0)
    ).drop("at")
    every = alone.unionByName(several).where("copies > 0")
    repeated = every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
