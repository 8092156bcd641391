"""Shape of a numeric column per key: summary, box, density, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.grouping import count_by, known, names
from cohortwise.operators.ordering import matched, quantiles_of, value_counts

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_by(df: DataFrame, keys: str | Sequence[str], col: str) -> DataFrame:
    """Mean, sample deviation, exact median and count of known values per key.

    A key whose values are all missing keeps its row, with a count of 0.
    """
    keys = names(keys)
    value = F.col(col).cast("double")
    moments = known(df, keys).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(col).alias("count")
    )
    medians = quantiles_of(value_counts(df, keys, col), keys, col, {"median": 0.5})
    medians = moments.join(medians, keys, "left") if keys else matched(moments, medians, keys)
    return medians.select(*keys, "mean", "std", "median", "count")


def _fenced(counts: DataFrame, keys: list[str], col: str, reach: float) -> DataFrame:
    """Each distinct known value beside its key's quartiles and fences."""
    step = (F.col("q3") - F.col("q1")) * F.lit(reach)
    fences = quantiles_of(counts, keys, col, _QUARTILES).withColumns(
        {"lower_fence": F.col("q1") - step, "upper_fence": F.col("q3") + step}
    )
    outside = (F.col(col) < F.col("lower_fence")) | (F.col(col) > F.col("upper_fence"))
    return matched(counts, fences, keys).withColumn("_outside", outside)


def box_stats_by(
    df: DataFrame,
    keys: str | Sequence[str],
    col: str,
    reach: float = 1.5,
    copies: str | None = None,
) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier count per key."""
    keys = names(keys)
    fenced = _fenced(value_counts(df, keys, col, copies), keys, col, reach)
    inner = F.when(~F.col("_outside"), F.col(col))
    return fenced.groupBy(*keys, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.sum("copies").alias("n"),
        F.min(inner).alias("whisker_low"),
        F.max(inner).alias("whisker_high"),
        F.sum(F.when(F.col("_outside"), F.col("copies")).otherwise(0)).alias("outliers"),
    )


def box_outliers(
    df: DataFrame, keys: str | Sequence[str], col: str, reach: float = 1.5
) -> DataFrame:
    """Distinct values beyond the fences, with how often each occurs."""
    keys = names(keys)
    fenced = _fenced(value_counts(df, keys, col), keys, col, reach)
    return fenced.where("_outside").select(*keys, col, "copies")


def density_by(
    df: DataFrame,
    keys: str | Sequence[str],
    col: str,
    grid: Sequence[float],
    bandwidth: float | None = None,
) -> DataFrame:
    """Gaussian kernel density per key at each grid point.

    Without a bandwidth each key uses 1.059 * min(std, IQR / 1.349) * n ** -0.2.
    The kernel sums of all grid points are built side by side while the values are
    read, so a value is one row and only one row per key is shuffled.
    """
    keys = names(keys)
    counts = value_counts(df, keys, col)
    value = F.col(col).cast("double")
    stats = known(df, [*keys, col]).groupBy(*keys).agg(
        F.count(col).alias("n"), F.stddev_samp(value).alias("std")
    )
    if bandwidth is None:
        stats = matched(stats, quantiles_of(counts, keys, col, _QUARTILES), keys)
        spread = F.least(F.col("std"), (F.col("q3") - F.col("q1")) / 1.349)
        width = F.nullif(F.lit(1.059) * spread * F.pow("n", F.lit(-0.2)), F.lit(0.0))
    else:
        width = F.lit(float(bandwidth))
    scale = F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi())
    sums = {}
    for i, point in enumerate(grid):
        spot = (F.lit(float(point)) - F.col(col)) / F.col("bandwidth")
        sums[f"_mass{i}"] = F.sum(F.exp(spot * spot * -0.5) * F.col("copies"))
    masses = (
        matched(counts, stats.select(*keys, "n", width.alias("bandwidth")), keys)
        .groupBy(*keys, "n", "bandwidth")
        .agg(*[total.alias(name) for name, total in sums.items()])
    )
    points = F.array(
        *[
            F.struct(F.lit(float(g)).alias("x"), (F.col(f"_mass{i}") / scale).alias("density"))
            for i, g in enumerate(grid)
        ]
    )
    return masses.select(*keys, F.inline(points))


def histogram(
    df: DataFrame,
    keys: str | Sequence[str],
    col: str,
    lo: float = 0.0,
    hi: float = 100.0,
    bins: int = 40,
) -> DataFrame:
    """Counts per key in equal-width bins over [lo, hi]; ``hi`` joins the last bin.

    Values below ``lo`` are counted in bin 0, values above ``hi`` in bin ``bins`` + 1.
    """
    keys = names(keys)
    slot = F.least(F.floor((F.col(col) - lo) * bins / (hi - lo)).cast("int") + 1, F.lit(bins))
    slot = F.when(F.col(col) < lo, 0).when(F.col(col) > hi, bins + 1).otherwise(slot)
    return count_by(known(df, [col]).withColumn("bin", slot), [*keys, "bin"])
