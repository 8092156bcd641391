"""Column functions against hand-computed rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import aggregates as A
from cohortwise.functions import bands as B
from cohortwise.functions import periods as P
from cohortwise.functions import scalars as S


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_rate_keeps_null_rows_in_the_denominator(spark):
    df = spark.createDataFrame([("attended",), (None,), ("x",)], "v string")
    assert df.agg(A.rate_of("v", "attended")).first()[0] == pytest.approx(33.333333, abs=1e-6)


def test_timing_band_edges(spark):
    hours = [-500.0, -200.0, -199.9, -1.0, -0.5, 0.0, 6.0, 24.0, 200.0, 900.0, None]
    got = column(spark, hours, "double", B.timing_band("v"))
    assert got == [
        None, None, "Late", "Late", "<6h", "<6h", "<6h", "6–24h", ">24h", ">24h", None,
    ]


def test_age_band_edges(spark):
    ages = [0.0, 19.0, 20.0, 22.0, 25.0, 30.0, 31.0, 100.0, 101.0, math.nan]
    got = column(spark, ages, "double", B.age_band("v"))
    assert got == [
        None, "≤19", "20–22", "20–22", "23–25", "26–30", "31+", "31+", None, None,
    ]


@pytest.mark.parametrize(
    ("n", "sizes"), [(1, [1]), (5, [2, 1, 1, 1]), (6, [2, 1, 1, 2]), (8, [2, 2, 2, 2])]
)
def test_quartile_sizes(spark, n, sizes):
    ranks = spark.range(1, n + 1).select(B.quantile_bin("id", F.lit(n)).alias("b"))
    assert [r["count"] for r in ranks.groupBy("b").count().orderBy("b").collect()] == sizes


def test_words(spark):
    assert column(spark, [0.6, 0.61, 0.3, -0.9, None], "double", B.strength("v")) == [
        "Moderate", "Strong", "Weak", "Strong", "Weak",
    ]
    assert column(spark, [5.0, 5.1, -5.1], "double", B.trend_word("v")) == [
        "flat", "improving", "declining",
    ]
    assert column(spark, [0.05, 0.051, -0.06], "double", B.direction("v")) == [None, "up", "down"]
    assert column(spark, [39.9, 40.0, 60.0, 80.0], "double", B.risk_tier("v")) == [None, 1, 2, 3]
    assert column(spark, [40.0, 40.1], "double", B.flag_over("v")) == [False, True]


def test_periods(spark):
    days = [dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 5, 23, 59), None]
    both = "2024-12-30/2025-01-05"
    assert column(spark, days, "timestamp_ntz", P.week_key("v")) == [both, both, None]
    assert column(spark, days, "timestamp_ntz", P.month_key("v")) == ["2025-01", "2025-01", None]
    assert column(spark, days, "timestamp_ntz", P.day_name("v")) == ["Wednesday", "Sunday", None]
    assert column(spark, days, "timestamp_ntz", P.name_of_day(F.weekday("v"))) == [
        "Wednesday", "Sunday", None,
    ]
    assert column(spark, days, "timestamp_ntz", P.name_of_month(F.month("v")))[0] == "January"
    with pytest.raises(ValueError):
        P.period_start("v", "year")


def test_hours_ignore_daylight_saving(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(
            [
                (dt.datetime(2024, 3, 10, 3, 30), dt.datetime(2024, 3, 10, 1, 0)),
                (dt.datetime(2024, 3, 10, 4, 0), dt.datetime(2024, 3, 10, 2, 30)),  # skipped hour
                (dt.datetime(2024, 3, 9, 0, 0), dt.datetime(2023, 3, 9, 0, 0, 0, 500000)),
            ],
            "a timestamp_ntz, b timestamp_ntz",
        )
        got = df.select(S.hours_between("a", "b"), S.hours_between("b", "a")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [tuple(r) for r in got[:2]] == [(2.5, -2.5), (1.5, -1.5)]
    assert got[2][0] == pytest.approx(366 * 24 - 0.5 / 3600, abs=1e-9)


def test_scalar_helpers(spark):
    assert column(spark, [-3.0, 5.0, None], "double", S.clip("v", lo=0.0)) == [0.0, 5.0, None]
    assert column(spark, [-300.0, 500.0], "double", S.clip("v", -200.0, 200.0)) == [-200.0, 200.0]
    pair = spark.createDataFrame([(-3, 0), (10, 50)], "d int, s int")
    assert [r[0] for r in pair.select(S.pct_of("d", "s")).collect()] == [100.0, 20.0]
    assert column(spark, [-3, 0], "int", S.gap_size("v")) == [4, 1]
    assert column(spark, ["a", "z"], "string", S.map_values("v", {"a": "A"})) == ["A", None]
    assert column(spark, [65.14, 100.0], "double", S.percent_text("v")) == ["65.1%", "100.0%"]
    assert column(spark, [0.5, 1.5, 2.5], "double", S.round_half_even("v")) == [0.0, 2.0, 2.0]
    assert column(spark, [-500.0, 0.0, 500.0], "double", S.in_open_range("v", -500, 500)) == [
        False, True, False,
    ]


def test_student_without_rows_is_flagged(spark):
    df = spark.createDataFrame(
        [(None, None), (60.0, 55.0), (59.9, 99.0)], "att_rate double, avg_grade double"
    )
    flags = df.select(S.flag_below({"att_rate": 60, "avg_grade": 55})).collect()
    assert [r[0] for r in flags] == [True, False, True]


def test_aggregates_on_missing_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", None, 2.0), ("a", 3.0, None)], "k string, x double, y double"
    )
    nothing = df.where("x is null")
    assert nothing.agg(A.total("x")).first()[0] == 0.0
    assert df.agg(A.pearson("x", "y")).first()[0] is None
    flat = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "x double, y double")
    assert flat.agg(A.pearson("x", "y")).first()[0] is None
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (9.0, None)], "x double, y double")
    assert line.agg(A.pearson("x", "y")).first()[0] == pytest.approx(1.0)
    flags = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert flags.agg(A.share_true("f")).first()[0] == 50.0
