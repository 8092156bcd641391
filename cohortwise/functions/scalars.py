"""Row-wise expressions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DayTimeIntervalType

_SECONDS = DayTimeIntervalType(DayTimeIntervalType.SECOND, DayTimeIntervalType.SECOND)


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip(col: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value on one or both sides; NULL stays NULL."""
    value = as_column(col)
    bounded = value
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(lo))
    if hi is not None:
        bounded = F.least(bounded, F.lit(hi))
    return F.when(value.isNotNull(), bounded)


def pct_of(num: Column | str, den: Column | str, when_zero: float = 100.0) -> Column:
    """``num`` as a percentage of ``den``; a zero denominator gives ``when_zero``."""
    share = as_column(num) / F.nullif(as_column(den).cast("double"), F.lit(0.0)) * 100
    return F.coalesce(share, F.lit(when_zero))


def gap_size(col: Column | str) -> Column:
    """Absolute gap plus one, a marker size that is never zero."""
    return F.abs(as_column(col)) + 1


def map_values(col: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace each value by its label; values without a label become NULL."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, as_column(col))


def flag_below(limits: Mapping[str, float]) -> Column:
    """True where any column, missing read as 0, lies below its limit."""
    tests = [F.coalesce(F.col(c), F.lit(0.0)) < F.lit(float(v)) for c, v in limits.items()]
    return reduce(lambda a, b: a | b, tests)


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Signed difference in hours, keeping fractions.

    Naive timestamps are subtracted as they stand. (``timestamp_diff`` would
    move readings that a session zone skips when its clocks go forward.)
    """
    span = (as_column(later) - as_column(earlier)).cast(_SECONDS)
    return span.cast("decimal(18,6)").cast("double") / 3600


def seconds_to_hours(col: Column | str) -> Column:
    return as_column(col) / 3600


def round_half_even(col: Column | str, digits: int = 0) -> Column:
    return F.bround(as_column(col), digits)


def percent_text(col: Column | str, digits: int = 1) -> Column:
    """A rounded number followed by a percent sign."""
    return F.concat(round_half_even(col, digits).cast("string"), F.lit("%"))


def title_case(col: Column | str) -> Column:
    return F.initcap(as_column(col))


def vs_mean_flag(col: Column | str, mean: Column) -> Column:
    """``below`` or ``above``, relative to a mean."""
    return F.when(as_column(col) < mean, "below").otherwise("above")


def in_open_range(col: Column | str, lo: float, hi: float) -> Column:
    value = as_column(col)
    return (value > F.lit(lo)) & (value < F.lit(hi))
