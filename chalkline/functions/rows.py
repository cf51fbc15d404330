"""Rows from arrays.

For a plain ``explode`` or ``inline`` the optimizer adds a filter on the array's size and
pushes it down to the scan, where a costly array expression is then computed a second time. The
outer forms plus a filter on the result say the same without that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_into(df: DataFrame, keep: list[str | Column], array: Column, name: str) -> DataFrame:
    """``keep`` columns plus one row per non-null element as ``name``."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexplode_into(df: DataFrame, keep: list[str | Column], array: Column, position: str, name: str) -> DataFrame:
    """As ``explode_into`` with the 0-based position."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(name).isNotNull())


def inline_into(df: DataFrame, keep: list[str | Column], array: Column, first: str) -> DataFrame:
    """``keep`` columns plus the fields of each element; ``first`` is a field that is never null."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(first).isNotNull())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once a row. Written out, every mention of a column expression is
    another computation of it, and those multiply from step to step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
