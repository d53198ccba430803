"""Calendar functions with the reference dialect's conventions.

* Year difference counts calendar-year boundaries, ignoring the day.
* Week number: week 1 holds 1 January and weeks start on Sunday.
* Weekday number: Sunday = 1 ... Saturday = 7 (Spark's ``dayofweek``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnkit.functions.text import as_col


def date_lit(d: str) -> Column:
    return F.lit(d).cast("date")


def year_diff(start, end) -> Column:
    """Calendar years between two dates: ``year(end) - year(start)``."""
    return F.year(as_col(end)) - F.year(as_col(start))


def day_diff(start, end) -> Column:
    """Days from ``start`` to ``end``."""
    return F.datediff(as_col(end), as_col(start))


def date_key(d) -> Column:
    """``yyyymmdd`` as an int."""
    d = as_col(d)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def week_of_year_sunday(d) -> Column:
    """Week number with week 1 holding 1 January and weeks starting on Sunday."""
    d = as_col(d)
    jan1_weekday = F.dayofweek(F.trunc(d, "year"))
    return (F.floor((F.dayofyear(d) + jan1_weekday - 2) / 7) + 1).cast("int")


def weekday_number(d) -> Column:
    """Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(as_col(d))


def month_name(d) -> Column:
    return F.date_format(as_col(d), "MMMM")


def weekday_name(d) -> Column:
    return F.date_format(as_col(d), "EEEE")


def year_month(d) -> Column:
    return F.date_format(as_col(d), "yyyy-MM")
