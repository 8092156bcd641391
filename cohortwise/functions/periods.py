"""Calendar buckets of naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise.functions.scalars import as_column

# Fixed value: the column order of the day-of-week grid.
DAYS = ["Saturday", "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]


def month_start(ts: Column | str) -> Column:
    """First day of the month, as a date; group by this and format afterwards."""
    return F.trunc(F.to_date(as_column(ts)), "month")


def week_start(ts: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(F.to_date(as_column(ts)), "week")


def month_key(ts: Column | str) -> Column:
    """``YYYY-MM``."""
    return F.date_format(F.to_date(as_column(ts)), "yyyy-MM")


def week_key(ts: Column | str) -> Column:
    """``Monday/Sunday`` of the week, both as ``YYYY-MM-DD``."""
    monday = week_start(ts)
    return F.concat(
        monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string")
    )


def month_name(ts: Column | str) -> Column:
    return F.date_format(F.to_date(as_column(ts)), "MMMM")


def day_name(ts: Column | str) -> Column:
    return F.date_format(F.to_date(as_column(ts)), "EEEE")


def name_of_month(number: Column | str) -> Column:
    """Full name of a month number, 1 to 12."""
    return month_name(F.make_date(F.lit(2024), as_column(number), F.lit(1)))


def name_of_day(number: Column | str) -> Column:
    """Full name of a weekday number, Monday 0 to Sunday 6."""
    return day_name(F.date_add(F.lit("2024-01-01").cast("date"), as_column(number)))


def period_start(ts: Column | str, grain: str) -> Column:
    """First day of the month or week a timestamp falls in."""
    if grain == "month":
        return month_start(ts)
    if grain == "week":
        return week_start(ts)
    raise ValueError(f"grain must be 'month' or 'week', not {grain!r}")
