"""Falling activity and the weighted risk score."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.periods import period_start
from cohortwise.functions.scalars import clip
from cohortwise.operators.grouping import count_by, with_scalars
from cohortwise.operators.scaling import unit_scaled

# Weights of the four risk measures.
RISK_WEIGHTS = {"att_rate": 0.35, "eng_decline": 0.25, "avg_grade": 0.25, "failed_c": 0.15}


def middle_period(df: DataFrame, period: str) -> Column:
    """The period at index ``n // 2`` of the sorted distinct periods."""
    ordered = F.sort_array(F.collect_set(period))
    middle = F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)
    return df.select(period).distinct().agg(middle).scalar()


def activity_decline(events: DataFrame, ts: str, grain: str = "month") -> DataFrame:
    """Mean events per active period, first half minus second half, per student."""
    per_period = count_by(
        events.withColumn("period", period_start(ts, grain)), ["student_id", "period"], "events"
    )
    early = F.col("period") <= middle_period(per_period, "period")
    halves = per_period.groupBy("student_id").agg(
        F.coalesce(F.avg(F.when(early, F.col("events"))), F.lit(0.0)).alias("eng_first"),
        F.coalesce(F.avg(F.when(~early, F.col("events"))), F.lit(0.0)).alias("eng_last"),
    )
    return halves.withColumn("eng_decline", F.col("eng_first") - F.col("eng_last"))


def _exposure() -> dict[str, Column]:
    """The four measures turned so that more means more at risk."""
    return {
        "att_rate": 100 - F.col("att_rate"),
        "eng_decline": clip("eng_decline", lo=0.0),
        "avg_grade": 100 - F.col("avg_grade"),
        "failed_c": F.col("failed_c").cast("double"),
    }


def risk_score(
    df: DataFrame, weights: Mapping[str, float] = RISK_WEIGHTS, of: DataFrame | None = None
) -> DataFrame:
    """Add ``risk_score``: weighted sum of the min-max scaled exposures, times 100.

    The ends of each scale come from ``of``: the same students and measures,
    possibly without the descriptive columns, so that finding them is cheaper.
    """
    exposure = _exposure()
    exposed = df.withColumns({f"_x_{name}": value for name, value in exposure.items()})
    ends = {f"{name}_lo": F.min(value) for name, value in exposure.items()}
    ends |= {f"{name}_hi": F.max(value) for name, value in exposure.items()}
    scored = with_scalars(exposed, df if of is None else of, "_ends", **ends)
    terms = [
        unit_scaled(F.col(f"_x_{n}"), F.col(f"_ends.{n}_lo"), F.col(f"_ends.{n}_hi")) * float(w)
        for n, w in weights.items()
    ]
    score = reduce(lambda a, b: a + b, terms) * 100
    return scored.withColumn("risk_score", score).select(*df.columns, "risk_score")
