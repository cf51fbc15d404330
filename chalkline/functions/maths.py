"""rounding rules and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def half_even(x: Column, places: int = 0) -> Column:
    """Round halves to the even neighbour."""
    return F.bround(x, places)


def rate(part: Column, whole: Column, places: int) -> Column:
    """100 x part / whole, 0 when there is nothing; halves away from zero."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, places)).otherwise(F.lit(0.0))


def rate_or_null(part: Column, whole: Column, places: int) -> Column:
    """As ``rate`` but NULL when there is nothing."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, places))


def whole_pct(part: Column, whole: Column) -> Column:
    """100 x part / whole as a whole number, halves up, 0 when there is nothing."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(0)).cast("bigint")


def wcpm(correct: Column, seconds: Column) -> Column:
    """Words correct per minute, two decimals, 0 without time."""
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(F.round(correct.cast("double") / seconds * 60, 2))


def attendance_pct(present: Column, total: Column) -> Column:
    """Present share in percent, two decimals, 0 without students."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.round(present.cast("double") / total * 100, 2))
