"""Column builders for calendar parts of a date and for the as-of date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, date_col: str) -> Column:
    """Largest date of the table as a scalar subquery: no driver round trip."""
    return df.agg(F.max(date_col).alias("latest")).scalar()


def as_of_date(as_of: dt.date | str | Column | None, df: DataFrame, date_col: str) -> Column:
    """``as_of`` as a column; the table's own last date when it is None."""
    if as_of is None:
        return latest(df, date_col)
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def hour_of(time_col: str = "time") -> Column:
    """Hour of an ``HH:mm:ss`` text; unreadable text gives null."""
    return F.hour(F.try_to_timestamp(F.col(time_col), F.lit("HH:mm:ss")))


def week_date(year: Column, week: Column) -> Column:
    """January 1 of ``year`` plus whole weeks: the weekly series' approximate date."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (week - 1) * 7)


def iso_year(date: Column) -> Column:
    """Year the date's ISO week belongs to: that of the week's Thursday."""
    return F.year(F.date_add(F.date_trunc("week", date).cast("date"), 3))


def week_of_month(date: Column) -> Column:
    """1 for days 1 to 6, 2 for days 7 to 13, and so on up to 5."""
    return (F.dayofmonth(date) / 7).cast("int") + 1


def month_name(month: Column) -> Column:
    """English name of a month number; null outside 1 to 12."""
    first_day = F.make_date(F.lit(2000), month, F.lit(1))
    return F.when(month.between(1, 12), F.date_format(first_day, "MMMM"))


def month_number(month: int | str) -> int:
    """Month given as a number or as its English name."""
    return month if isinstance(month, int) else dt.datetime.strptime(month, "%B").month


def date_range(
    year: int, month: int | None = None, week: int | None = None
) -> tuple[dt.date, dt.date]:
    """First day and the day after the last of a year, a month, or a week of a month.

    Weeks of the month are those of :func:`week_of_month`. A week that the month does not
    have gives a range that begins and ends on the same day.
    """
    if month is None:
        return dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    start = dt.date(year, month, 1)
    end = dt.date(year + month // 12, month % 12 + 1, 1)
    if week is None:
        return start, end
    first = start + dt.timedelta(days=max(0, 7 * (week - 1) - 1))
    return min(max(first, start), end), max(start, min(start + dt.timedelta(days=7 * week - 1), end))
