"""Ordered work over keys of any size.

A plain ``Window.partitionBy(user).orderBy(ts)`` puts all rows of one user into
one task. These helpers cut every key into chunks along its own order (an hour
of a user's events, 10 000 positions of a list), run the window per
``(key, chunk)`` and carry the state over chunk borders through a table with one
row per ``(key, chunk)``. The result is the same as with the plain window.

``chunk`` must never decrease along the order and be computed from it; a number
asks for chunks of about so many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.session import stored

#: runs into which rows are dealt by range, at most
MOST_RUNS = 20_000


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | int) -> DataFrame:
    """Add ``_g``, the key and the chunk of a row as one value.

    A struct is never NULL itself and equal to another one with NULL in the same place. So window
    and join partition by the same plain column, and one shuffle serves both.

    A number as ``chunk`` deals the rows by range of (keys, order) into runs of about that many rows (more, beyond
    ``MOST_RUNS`` runs). The run is the chunk, so a key is cut anywhere, between equal values of its first order column
    too, and a run holds many small keys. The borders come from a sample that a second plan would draw anew, so
    the rows are written once with their run.
    """
    if isinstance(chunk, int):
        runs = max(1, min(MOST_RUNS, -(-df.count() // chunk)))
        dealt = df.repartitionByRange(runs, *keys, *order)
        return stored(dealt.withColumn("_g", F.struct(*keys, F.spark_partition_id().alias("_chunk"))))
    return df.withColumn("_g", F.struct(*keys, chunk.alias("_chunk")))


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | int,
    lag: Sequence[str] = (),
    number: str | None = None,
) -> DataFrame:
    """Add ``prev_<column>`` from the row before and the 1-based position within the key.

    The rows are shuffled once, for window and join. The table of chunks comes from a second, narrow
    scan that is aggregated before its shuffle."""
    keys, order = list(keys), list(order)
    rows = _chunked(df, keys, order, chunk)
    within = Window.partitionBy("_g").orderBy(*order)
    across = Window.partitionBy(*[F.col("_g")[k] for k in keys]).orderBy(F.col("_g")["_chunk"])
    sums, carried, carries = [], [], F.lit(False)
    if lag:
        sums.append(F.max_by(F.struct(*lag), F.struct(*order)).alias("_last"))
        carried.append(F.lag("_last").over(across).alias("_carry"))
        carries = carries | F.col("_carry").isNotNull()
    if number:
        sums.append(F.count("*").alias("_n"))
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.sum("_n").over(before).alias("_before"))
        carries = carries | F.col("_before").isNotNull()
    # a key's first chunk gets nothing; where keys have one chunk, no row is left to join
    chunks = rows.groupBy("_g").agg(*sums).select("_g", *carried).filter(carries)
    placed = rows.withColumn("_nth", F.row_number().over(within))
    for value in lag:
        placed = placed.withColumn(f"prev_{value}", F.lag(value).over(within))
    out = [F.col(c) for c in df.columns]
    for value in lag:
        first = F.col("_nth") == 1
        out.append(F.when(first, F.col(f"_carry.{value}")).otherwise(F.col(f"prev_{value}")).alias(f"prev_{value}"))
    if number:
        out.append((F.col("_nth") + F.coalesce(F.col("_before"), F.lit(0))).alias(number))
    return placed.join(chunks, "_g", "left").select(*out)


def carry_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunk: Column | int) -> DataFrame:
    """Add ``prev_<value>`` from the row before within the key."""
    return in_order(df, keys, order, chunk, lag=list(values))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    chunk: Column | int,
) -> DataFrame:
    """Add the inclusive running sum of ``value`` within the key as ``name``."""
    keys, order = list(keys), list(order)
    rows = _chunked(df, keys, order, chunk).withColumn("_v", value)
    within = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*[F.col("_g")[k] for k in keys]).orderBy(F.col("_g")["_chunk"])
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_g").agg(F.sum("_v").alias("_s"))
    offsets = sums.select("_g", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_run", F.sum("_v").over(within))
    return placed.join(offsets, "_g", "left").select(*df.columns, (F.col("_run") + F.col("_before")).alias(name))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunk: Column | int) -> DataFrame:
    """Add the 1-based position within the key."""
    return in_order(df, keys, order, chunk, number=name)


def time_chunk(column: str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(column))


def position_chunk(column: str, size: int = 10_000) -> Column:
    return F.floor(F.col(column) / F.lit(size))


def with_neighbours(
    df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, size: int = 10_000
) -> DataFrame:
    """Copy rows near a block border into the next block.

    ``position`` is dense within the key, from 0 or 1 on, so there is no block before block 0 to copy
    into. Adds ``_block`` and ``_home``: a frame of up to ``before``/``after`` rows over ``(key, _block)``
    is then right for every row with ``_home``; the caller drops the others.
    """
    if before > size or after > size:
        raise ValueError("a block must be at least as long as the frame")
    pos = F.col(position)
    home = F.floor(pos / size)
    offset = pos - home * size
    blocks = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - before, home + 1),
            F.when((offset < after) & (home != 0), home - 1),
        )
    )
    return df.withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_block") == home)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark keeps at most ``n`` rows per key and task before
    the shuffle (window group limit), so a hot key stays small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
