"""Date expressions: week-ending-Friday bins and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holiday weeks of the stand-in calendar (ISO week numbers).
HOLIDAY_WEEKS = (6, 36, 47, 52)


def week_ending_friday(c: Column | str) -> Column:
    """Friday that ends the Saturday-Friday week of ``c`` (a Friday maps to itself).

    Same bin as a pandas ``resample('W-FRI')`` label: right-closed, right-labelled.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.next_day(F.date_sub(c.cast("date"), 1), "FRI")


def parse_dmy(c: Column | str) -> Column:
    """Parse ``dd/MM/yyyy`` text into a date."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(c, "dd/MM/yyyy")


def iso_week(c: Column | str) -> Column:
    return F.weekofyear(c).cast("int")


def is_holiday_week(date: Column | str) -> Column:
    return iso_week(date).isin(*HOLIDAY_WEEKS)


def add_weeks(c: Column | str, n: int | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    n = F.lit(n) if isinstance(n, int) else n
    return F.date_add(c, n * 7)
