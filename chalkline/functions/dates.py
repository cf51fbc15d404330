"""calendar rules as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(day: Column) -> Column:
    """August to November is fall, December to February winter, the rest spring."""
    month = F.month(day)
    return F.when(month.between(8, 11), "fall").when(month.isin(12, 1, 2), "winter").otherwise("spring")


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def _weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def previous_working_day(day: Column) -> Column:
    """Latest Monday-to-Friday strictly before ``day``."""
    back = F.when(_weekday(day) == 0, 3).when(_weekday(day) == 6, 2).otherwise(1)
    return F.date_sub(day, back)


def working_days(lo: Column, hi: Column) -> Column:
    """Monday-to-Friday days in ``[lo, hi]``, at least 1. Closed form: whole weeks plus the rest."""

    def until(day: Column) -> Column:
        # working days in (-inf, day], counted from Monday 1970-01-05
        n = F.datediff(day, F.lit("1970-01-05").cast("date")) + 1
        weeks = F.floor(n / F.lit(7))
        return weeks * 5 + F.least(n - weeks * 7, F.lit(5))

    return F.greatest(until(hi) - until(F.date_sub(lo, 1)), F.lit(1)).cast("int")


def weekly_window(day: Column) -> Column:
    """The seven days that end on ``day``."""
    return F.struct(F.date_sub(day, 6).alias("lo"), day.alias("hi"))


def brief_kind(day: Column) -> Column:
    """Friday weekly, Monday to Thursday daily, else none."""
    return F.when(_weekday(day) == 4, "weekly").when(_weekday(day) < 4, "daily")


def window_for(day: dt.date, kind: str) -> tuple[dt.date, dt.date]:
    """The covered window of a brief as plain dates."""
    return (day - dt.timedelta(days=6), day) if kind == "weekly" else (day, day)


def window_before(lo: dt.date, hi: dt.date) -> tuple[dt.date, dt.date]:
    """The equally long window just before."""
    span = dt.timedelta(days=(hi - lo).days + 1)
    return lo - span, hi - span
