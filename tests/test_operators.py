"""Operators against brute force on small, awkward inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import cleaning, distribution, grouping, ordering, regression, reshape
from cohortwise.operators.scaling import min_max_norm, zscore


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def skewed(spark, n=3000, seed=1):
    """A third of all rows on one key, a third of those on one value; some NULLs."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = 50.0 if i % 9 == 0 else round(rng.uniform(0, 100), 2)
        data.append((i, key, None if i % 50 == 7 else value))
    return spark.createDataFrame(data, "id long, k string, v double").repartition(8)


def test_grouped_counts_skip_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0)], "k string, v double")
    got = grouping.agg_by(df, "k", n=F.count(F.lit(1)), c=F.count("v"), s=F.sum("v"))
    assert rows(got) == [("a", 2, 1, 1.0)]
    assert rows(grouping.sum_by(df.where("v is null"), "k", "v")) == [("a", 0.0)]
    assert rows(distribution.describe_by(df, "k", "v")) == [("a", 1.0, None, 1.0, 1)]


def test_describe_keeps_keys_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r for r in distribution.describe_by(df, "k", "v").collect()}
    assert got["a"]["count"] == 0 and got["a"]["mean"] is None and got["a"]["median"] is None
    assert got["b"]["count"] == 1 and got["b"]["median"] == 2.0


def test_rank_and_quartiles_match_pandas(spark):
    df = skewed(spark)
    got = {r["id"]: r["rank"] for r in ordering.rank_first(df, "v", "id").collect()}
    pdf = df.toPandas().sort_values("id").dropna(subset=["v"])
    want = pdf.set_index("id")["v"].rank(method="first").astype(int)
    assert got == want.to_dict()
    bands = {r["id"]: r["band"] for r in ordering.quartile_band(df, "v", "id").collect()}
    cut = pd.qcut(want, 4, labels=["Q1 Low", "Q2", "Q3", "Q4 High"]).astype(str)
    assert bands == cut.to_dict()


def test_rank_within_keys(spark):
    df = skewed(spark).select("k", "id")
    got = {r["id"]: r["rank"] for r in ordering.rank_within(df, "k", ["id"]).collect()}
    pdf = df.toPandas().dropna()
    assert got == pdf.set_index("id").groupby("k")["k"].rank(method="first").pipe(
        lambda _: pdf.assign(r=pdf.groupby("k")["id"].rank().astype(int)).set_index("id")["r"]
    ).to_dict()


def test_quantiles_and_moments_match_pandas(spark):
    df = skewed(spark)
    probs = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "m": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}
    got = ordering.exact_quantiles(df, "k", "v", probs).toPandas().set_index("k").sort_index()
    pdf = df.toPandas().dropna(subset=["k"])
    for name, p in probs.items():
        np.testing.assert_allclose(got[name], pdf.groupby("k")["v"].quantile(p), rtol=1e-12)
    stats = distribution.describe_by(df, "k", "v").toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["v"].agg(["mean", "std", "median", "count"])
    np.testing.assert_allclose(stats[want.columns].astype(float), want.astype(float), rtol=1e-10)
    whole = ordering.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(df.toPandas()["v"].median())


def test_box_stats_and_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 100.0, None]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    box = distribution.box_stats_by(df, "k", "v").first()
    known = pd.Series(values).dropna()
    q1, q3 = known.quantile(0.25), known.quantile(0.75)
    assert (box["q1"], box["q3"], box["n"]) == (q1, q3, 7)
    assert box["upper_fence"] == q3 + 1.5 * (q3 - q1)
    tight = spark.createDataFrame(
        [("a", float(v)) for v in [*range(1, 12), 60, 60]], "k string, v double"
    )
    assert rows(distribution.box_outliers(tight, "k", "v")) == [("a", 60.0, 2)]
    assert distribution.box_stats_by(tight, "k", "v").first()["whisker_high"] == 11.0


def test_density_matches_direct_sum(spark):
    df = skewed(spark, 300)
    grid = [0.0, 25.0, 50.0, 100.0]
    got = distribution.density_by(df, "k", "v", grid, bandwidth=7.0).toPandas()
    pdf = df.toPandas().dropna()
    for key, part in pdf.groupby("k"):
        for x in grid:
            want = np.exp(-0.5 * ((x - part["v"]) / 7.0) ** 2).mean() / (7.0 * np.sqrt(2 * np.pi))
            mine = got[(got["k"] == key) & (got["x"] == x)]["density"].iloc[0]
            assert mine == pytest.approx(want, rel=1e-9)


def test_histogram_edges(spark):
    df = spark.createDataFrame(
        [("a", v) for v in [0.0, 2.49, 2.5, 100.0, 100.1, -0.1, None]], "k string, v double"
    )
    assert rows(distribution.histogram(df, "k", "v")) == [
        ("a", 0, 1), ("a", 1, 2), ("a", 2, 1), ("a", 40, 1), ("a", 41, 1),
    ]


def test_regression(spark):
    df = spark.createDataFrame(
        [("flat", 1, 5.0), ("flat", 2, 5.0), ("flat", 3, 5.0), ("two", 1, 1.0), ("two", 2, 9.0)],
        "k string, x int, y double",
    )
    assert rows(regression.linreg_by(df, "k", "x", "y")) == [("flat", 3, 0.0, 0.0)]
    const = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 4.0)], "k string, x double, y double")
    assert regression.ols_by(const, "k", "x", "y").first()["slope"] is None


def test_scaling_of_constant_columns(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 5.0)], "id int, c double, d double")
    assert rows(min_max_norm(df, ["c", "d"])) == [(1, 0.0, 0.0), (2, 0.0, 1.0)]
    assert rows(zscore(df, ["c", "d"])) == [(1, 0.0, -1.0), (2, 0.0, 1.0)]


def test_grid_and_pivots(spark):
    df = spark.createDataFrame([("c1", "a", 10.0), ("c2", "b", 20.0)], "c string, n string, v double")
    assert rows(reshape.cells_long(df, "c", "n", "v")) == [("c1", "a", 10.0), ("c2", "b", 20.0)]
    assert rows(reshape.cells_long(df, "c", "n", "v", ["a", "z"])) == [
        ("c1", "a", 10.0), ("c1", "z", 0.0), ("c2", "a", 0.0), ("c2", "b", 20.0), ("c2", "z", 0.0),
    ]
    with pytest.raises(Exception, match="n without a column: b"):
        reshape.pivot_rate(df, "c", "n", "v", ["a"]).collect()
    assert rows(reshape.pivot_rate(df, "c", "n", "v", ["a", "b"])) == [
        ("c1", 10.0, 0.0), ("c2", 0.0, 20.0),
    ]
    days = spark.createDataFrame([("May", "Friday", 1.0)], "month string, dow string, rate double")
    grid = reshape.pivot_days(days)
    assert grid.columns == [
        "month", "Saturday", "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
    ]
    assert grid.first()["Friday"] == 1.0 and grid.first()["Monday"] is None


def test_filters_and_top_values(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 6.0), (None, 3.0)], "k string, v double")
    assert rows(grouping.where_vs_mean(df, "v").select("v")) == [(1.0,), (2.0,)]
    assert rows(grouping.top_values(df, "k", 1)) == [("y", 2)]
    assert rows(grouping.share(df, "k")) == [("x", 1, pytest.approx(100 / 3)), ("y", 2, pytest.approx(200 / 3))]
    ids = spark.createDataFrame([("y",), ("y",)], "k string")
    assert grouping.restrict_to(df, ids, "k").count() == 2
    assert grouping.arg_extreme(df.where("k is not null"), "v", "k").first()["v"] == 6.0
    seq = spark.createDataFrame([("g", 2, 7.0), ("g", 1, 4.0)], "k string, s int, v double")
    assert rows(grouping.first_last(seq, "k", ["s"], "v")) == [("g", 4.0, 7.0, 3.0)]
    with pytest.raises(ValueError):
        grouping.where_vs_mean(df, "v", "=")


def test_cleaning(spark):
    df = spark.createDataFrame(
        [("2025-01-01 10:00", "1.5"), ("01/02/2025", "NaN"), ("bad", "x")], "t string, n string"
    )
    got = cleaning.to_timestamp_ntz(cleaning.to_number(df, ["n", "zz"]), ["t"])
    times = [r["t"] for r in got.collect()]
    assert times[0].hour == 10 and times[1:] == [None, None]
    assert [r["n"] for r in got.collect()] == [1.5, None, None]
    durations = spark.createDataFrame([(-1.0,), (0.0,), (7200.0,), (7201.0,), (None,)], "d double")
    kept = cleaning.null_outside(durations, "d", 0, 7200).collect()
    assert [r[0] for r in kept] == [None, 0.0, 7200.0, None, None]
    assert cleaning.drop_if_present(df, ["t", "absent"]).columns == ["n"]


def test_row_order_and_partitioning_do_not_matter(spark):
    df = skewed(spark)
    shuffled = df.orderBy(F.rand(3)).repartition(3)
    for make in (
        lambda d: ordering.quartile_band(d, "v", "id").select("id", "band"),
        lambda d: ordering.exact_quantiles(d, "k", "v", {"m": 0.5}),
        lambda d: distribution.box_outliers(d, "k", "v"),
    ):
        assert rows(make(df)) == rows(make(shuffled))


@pytest.mark.parametrize("partitions", [1, 8])
def test_far_values_and_heavy_ties_keep_their_places(spark, partitions):
    """One value far away leaves all others in the first bin; ties fold into one row."""
    values = [1e12, -5.0] + [float(i % 97) for i in range(3000)] + [12.25] * 2000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(partitions)
    got = ordering.exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.999, "d": 1.0}).first()
    want = pd.Series(values).quantile([0.1, 0.5, 0.999, 1.0])
    np.testing.assert_allclose(list(got), want.tolist(), rtol=1e-12)
    bands = {r["id"]: r["band_ord"] for r in ordering.quartile_band(df, "v", "id").collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert bands == {i: max(1, -(-4 * r // (len(values) - 1))) for r, i in enumerate(order)}


def test_quartiles_of_few_rows(spark):
    for n in (1, 2, 3, 6):
        df = spark.createDataFrame([(i, 5.0) for i in range(n)], "id long, v double")
        got = [r["band_ord"] for r in ordering.quartile_band(df, "v", "id").orderBy("id").collect()]
        assert got == [max(1, -(-4 * r // max(1, n - 1))) for r in range(n)]


def test_building_a_quantile_starts_no_job(spark):
    df = skewed(spark)
    spark.sparkContext.setJobGroup("quiet", "built only")
    try:
        ordering.exact_quantiles(df, "k", "v", {"m": 0.5})
        distribution.box_stats_by(df, "k", "v")
        distribution.density_by(df, "k", "v", [0.0, 1.0])
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("quiet")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_order_codes_rise_with_the_values(spark):
    inf = float("inf")
    draw = np.random.default_rng(4)
    spread = np.exp2(draw.uniform(-1080, 1023, 3000)) * draw.choice([-1, 1], 3000)
    edges = [s * np.exp2(float(e)) * f for s in (-1, 1) for e in range(-1070, 1023, 7) for f in (1.0, 1 - 2**-53, 1 + 2**-52)]
    values = sorted({*spread.tolist(), *map(float, edges), 0.0, 5e-324, -5e-324, 1.7976931348623157e308, inf, -inf})
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, float("nan")])], "i long, v double")
    codes = [r["c"] for r in df.select("i", ordering.order_code("v").alias("c")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(codes, codes[1:], strict=False))
    # Codes are shared only right beside powers of two, where the logarithm rounds.
    drawn = spread.tolist()
    drawn = [c for v, c in zip(values, codes, strict=False) if v in drawn]
    assert len(set(drawn)) == len(drawn)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_of_values_spread_over_magnitudes(spark, keys):
    """A far outlier, a crowd close together, both signs, ties and a hot key."""
    draw = np.random.default_rng(8)
    crowd = 7.0 + draw.integers(0, 5000, 4000) * 1e-9
    wide = np.power(10.0, draw.uniform(-12, 12, 3000)) * draw.choice([-1, 1], 3000)
    values = np.concatenate([crowd, wide, np.repeat(0.0, 500), [1e300, -1e300]])
    pdf = pd.DataFrame({"k": np.where(draw.random(len(values)) < 0.8, "hot", "cold"), "v": values})
    probs = {f"p{i}": i / 20 for i in range(21)}
    got = ordering.exact_quantiles(spark.createDataFrame(pdf), keys, "v", probs).toPandas()
    for name, p in probs.items():
        if keys:
            want = pdf.groupby("k")["v"].quantile(p)
            np.testing.assert_allclose(got.set_index("k")[name].reindex(want.index), want, rtol=1e-9, atol=1e-300)
        else:
            np.testing.assert_allclose(got[name][0], pdf["v"].quantile(p), rtol=1e-9, atol=1e-300)


def test_no_slice_of_a_long_tail_is_ordered_whole(spark):
    """Values over twelve magnitudes and an outlier: what shares both digits with a place is few rows."""
    values = [10 ** (12 * i / 20_000) for i in range(20_000)] + [1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    code = ordering.order_code("v")
    for bits, most in ((42, 80), (21, 2)):
        slices = df.groupBy(F.shiftright(code, bits).alias("s")).count()
        assert slices.agg(F.max("count")).first()[0] <= most
    plan = ordering.exact_quantiles(df, [], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "_high" in plan and "_middle" in plan
