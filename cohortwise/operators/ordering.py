"""Exact ranks, quantiles and quartile bands that never gather a group in one task.

Quantiles are found by counting: values are counted per key and digit of an order-preserving code, and only
the values that share two digits with a wanted place are put in order. No step needs the whole order,
and nothing runs before the result is asked for. Ranks of all rows need the order: rows are
range-partitioned and each partition is numbered from the rows before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.bands import QUARTILE_LABELS, band_label, quantile_bin
from cohortwise.operators.grouping import known, names
from cohortwise.session import pinned

_POSITION_BITS = 33  # monotonically_increasing_id: partition << 33 | row in partition
# A double's fraction and least power of two; a code has 22, 21 and 21 bits to its digits.
_FRACTION_BITS, _LEAST_POWER = 52, -1022
_DIGIT_BITS = (21, 21)


def with_position(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """Add each row's 0-based place in the whole table's order.

    Rows are range-partitioned, and the numbered partitions are stored once in the
    checkpoint folder, so that later readers see the same partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pinned(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns(
        {
            "_block": F.shiftright("_at", _POSITION_BITS),
            "_row": F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
        }
    )
    # One row per partition, so the unpartitioned window and the broadcast stay small.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_block")
        .withColumn(out, F.col("_offset") + F.col("_row"))
        .drop("_at", "_block", "_row", "_offset")
    )


def rank_first(df: DataFrame, col: str, tiebreak: str, out: str = "rank") -> DataFrame:
    """1-based rank of ``col``, ties in ``tiebreak`` order; missing values drop out."""
    ranked = with_position(known(df, [col]), [col, tiebreak], out)
    return ranked.withColumn(out, F.col(out) + 1)


def rank_within(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[str], out: str = "rank"
) -> DataFrame:
    """1-based rank inside each key, for keys with few rows, such as dates of a group."""
    keys = names(keys)
    within = Window.partitionBy(*keys).orderBy(*order)
    return known(df, [*keys, *order]).withColumn(out, F.row_number().over(within))


def value_counts(
    df: DataFrame, keys: str | Sequence[str], col: str, copies: str | None = None
) -> DataFrame:
    """Keys, value and ``copies``: how often each known value occurs.

    ``copies`` names a column saying how many rows an input row stands for. Counting
    folds ties, so a value shared by a third of all rows is a single row here.
    """
    keys = names(keys)
    rows = F.count(F.lit(1)) if copies is None else F.sum(copies)
    return known(df, [*keys, col]).groupBy(*keys, col).agg(rows.alias("copies"))


def matched(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``side``, one row per key, or one row in all without keys."""
    if keys:
        return df.join(side, list(keys))
    packed = df.withColumn("_side", side.agg(F.first(F.struct(*side.columns))).scalar())
    return packed.select("*", "_side.*").drop("_side")


def order_code(col: str) -> Column:
    """A whole number that rises with a numeric column: a double's sign, exponent and 52 further bits.

    Right beside powers of two rounding lets some hundred neighbours share a code; the order never
    changes. Infinities and NaN stand at the ends.
    """
    value = F.col(col).cast("double")
    size = F.abs(value)
    power = F.greatest(F.floor(F.log(size) / F.log(F.lit(2.0))), F.lit(_LEAST_POWER).cast("long"))
    part = (size / F.pow(F.lit(2.0), power) - 1.0) * F.lit(float(1 << _FRACTION_BITS))
    # Below the least power values are spaced evenly down to zero.
    part = F.when(power > _LEAST_POWER, F.greatest(part, F.lit(0.0))).otherwise(part)
    part = F.floor(F.least(part, F.lit(float((1 << _FRACTION_BITS) - 1))))
    code = F.shiftleft(power - _LEAST_POWER + 1, _FRACTION_BITS) + part
    largest = F.lit((1 << 63) - 1).cast("long")
    code = F.when(size == 0, F.lit(0).cast("long")).when(size >= F.lit(float("inf")), largest).otherwise(code)
    return F.when(value < 0, -code).otherwise(code)


def _digits() -> list[Column]:
    """The upper two of a code's three digits; a digit takes 2^22 values at most."""
    low, middle = _DIGIT_BITS
    return [F.shiftright("_code", low + middle), F.shiftright("_code", low).bitwiseAND(F.lit((1 << middle) - 1))]


def _slices_hit(rows: DataFrame, within: list[str], digit: str, carried: list[str], wanted: Column) -> DataFrame:
    """The slices of each ``within`` that hold a wanted place: (within, digit, _before, _wanted, carried).

    ``_start`` is the place of the first row of each ``within``.
    """
    filled = rows.groupBy(*within, digit, *carried).agg(F.sum("copies").alias("_n"))
    # A row per digit: 2^22 at most, few thousands unless values are spread over many magnitudes.
    key = Window.partitionBy(*within)
    earlier = key.orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if "_all" not in carried:
        filled = filled.withColumns({"_all": F.sum("_n").over(key), "_start": F.lit(0).cast("long")})
    filled = filled.withColumn("_before", F.col("_before") + F.col("_start")).withColumn("_asked", wanted)
    inside = F.filter(
        "_asked", lambda w: (w["place"] >= F.col("_before")) & (w["place"] < F.col("_before") + F.col("_n"))
    )
    return filled.withColumn("_wanted", inside).where(F.size("_wanted") > 0).select(
        *within, digit, "_before", "_wanted", "_all"
    )


def _at_places(
    counts: DataFrame, keys: list[str], col: str, places: Mapping[str, Column]
) -> DataFrame:
    """The values at 0-based ``places`` of each key's order: (keys, name, value, _all).

    ``places`` are expressions over ``_all``, the rows of the key. A radix descent: values are counted per key and
    first digit of their code, those of the slices that hold a place per second digit, and the values that
    share both digits with a place are put in order, 2^21 distinct codes at most however the values are spread.
    """
    high, middle = _digits()
    rows = counts.withColumn("_code", order_code(col)).withColumns({"_high": high, "_middle": middle})
    rows = rows.drop("_code")
    asked = F.array(
        *[F.struct(F.lit(n).alias("name"), p.cast("long").alias("place")) for n, p in places.items()]
    )
    first = _slices_hit(rows, keys, "_high", [], asked).withColumnsRenamed({"_before": "_start", "_wanted": "_held"})
    part = rows.join(first, [*keys, "_high"])
    second = _slices_hit(part, [*keys, "_high"], "_middle", ["_start", "_held", "_all"], F.col("_held"))
    running = Window.partitionBy(*keys, "_high", "_middle").orderBy(col)
    running = running.rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(second, [*keys, "_high", "_middle"]).withColumn(
        "_upto", F.col("_before") + F.coalesce(F.sum("copies").over(running), F.lit(0))
    )
    hit = found.withColumn("_hit", F.explode("_wanted")).where(
        (F.col("_hit.place") >= F.col("_upto")) & (F.col("_hit.place") < F.col("_upto") + F.col("copies"))
    )
    return hit.select(*keys, F.col("_hit.name").alias("name"), F.col(col).alias("value"), "_all")


def quantiles_of(
    counts: DataFrame, keys: str | Sequence[str], col: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per key of counted values; keys without values drop out."""
    keys = names(keys)
    spots = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in probs.items()}
    places = {f"{n}_lo": F.floor(s) for n, s in spots.items()} | {f"{n}_hi": F.ceil(s) for n, s in spots.items()}
    found = _at_places(counts, keys, col, places)

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)

    picked = found.groupBy(*keys).agg(F.max("_all").alias("_all"), *[pick(name) for name in places])
    part = {n: s - F.floor(s) for n, s in spots.items()}
    return picked.select(
        *keys,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * part[n]).alias(n)
            for n in probs
        ],
    )


def exact_quantiles(
    df: DataFrame, keys: str | Sequence[str], col: str, probs: Mapping[str, float]
) -> DataFrame:
    return quantiles_of(value_counts(df, keys, col), keys, col, probs)


def quartile_band(
    df: DataFrame, col: str, tiebreak: str, labels: Sequence[str] = tuple(QUARTILE_LABELS)
) -> DataFrame:
    """Cut the rank of ``col`` into equal quantiles: ``band_ord`` and ``band``.

    Ranks come from :func:`rank_first`, whose stored copy is written while this is built.
    """
    ranked = rank_first(df, col, tiebreak, "_rank")
    rows = ranked.agg(F.max("_rank")).scalar()
    banded = ranked.withColumn("band_ord", quantile_bin("_rank", rows, len(labels)))
    return banded.withColumn("band", band_label("band_ord", list(labels))).drop("_rank")
