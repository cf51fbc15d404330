"""Mix sources to token targets by entropy balancing: Newton steps on the convex dual, then whole copies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import blocks
from chalkline.llm.words import WORD
from chalkline.session import cut_lineage

#: a (source, size) cell above this many documents is cut into parts by a hash of the id
CELL = 10_000


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _key(source: str) -> Column:
    """A non-null stand-in for the source, so that null sources join by plain equality."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0):
    """Add ``target`` to (key, source, source_size).

    Sources in order of code points (null last) take the weights in turn and share ``share``
    times all sizes. No target passes ``cap`` times its source's size; what is over goes to the
    others by weight until none is above. That is the level at which filling stops: in order of
    cap / weight a first run of sources is full, the rest gets weight x level. The two windows see
    one row per source, nothing that grows with the documents of a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last(), "key")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    t = t.withColumn("most", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn(
        "level",
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    # the first source whose share does not fill it sets the level for all later ones
    open_ = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), "key", "level"))
    t = t.withColumn("level", F.coalesce(F.min(open_).over(everything)["level"], F.lit(math.inf)))
    return t.select("key", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    """cap / (1 + (cap - 1) exp(-tilt x)): rate 1 without tilt, between 0 and cap, odds exponential in x."""
    return F.when(tilt.isNull(), F.lit(cap)).otherwise(cap / (1 + (cap - 1) * F.exp(-tilt * size / mean)))


def solve_tilts(cells: DataFrame, goals: DataFrame, cap: float, tolerance: float, rounds: int) -> DataFrame:
    """(key, target, mean, tilt): the dual variable of each source.

    The rates minimise the relative entropy to one copy each (within 0 and ``cap``) under one
    constraint a source: the expected words equal its target. The dual is convex with a diagonal
    Hessian. A document matters only by its source and size, so each Newton step is an
    aggregation of (source, size, count) cells. From tilt 0 the step never passes the solution
    (the expectation is concave above one copy and convex below), so no line search is needed.
    """
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = goals.where("source_size > 0").select(
        "key", "target", F.lit(0.0).alias("tilt"), F.lit(False).alias("done"), full.alias("full")
    )
    means = cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).cast("double").alias("mean"))
    state = blocks.cut(state.join(means, "key"))
    for _ in range(rounds):
        size, mean, n = F.col("size").cast("double"), F.col("mean"), F.col("n")
        r = _rate(F.col("tilt"), size, mean, cap)
        sums = (
            cells.join(state.where("not done and not full").select("key", "tilt", "mean"), "key")
            .groupBy("key")
            .agg(F.sum(n * size * r).alias("got"), F.sum(n * size * size / mean * r * (1 - r / cap)).alias("slope"))
        )
        step = F.when(F.col("slope") > 0, (F.col("got") - F.col("target")) / F.col("slope")).otherwise(0.0)
        state = blocks.cut(
            state.join(sums, "key", "left").select(
                "key",
                "target",
                F.when(F.col("got").isNull(), F.col("tilt")).otherwise(F.col("tilt") - step).alias("tilt"),
                (F.col("got").isNull() | (F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target"))).alias("done"),
                "full",
                "mean",
            )
        )
        if state.where("not done and not full").isEmpty():
            break
    return state.select("key", "target", "mean", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def exchange(size: np.ndarray, k: np.ndarray, top: np.ndarray, error: float, moves: int = 200, steps: int = 8) -> np.ndarray:
    """``k`` with a few copies more or less, so that less of ``error`` (words still missing) is left.

    A move is one copy more or less of a cell, within 0 and ``top``. Each step applies the up to four moves that
    come closest: sums of two meet sums of two in a sorted list. Of more than ``moves`` moves, as many
    are tried, evenly over the sizes. At the end no move, and no two of those tried, bring it closer.
    """
    k = k.copy()
    for _ in range(steps):
        if abs(error) <= 0.5:
            break
        more, less = np.flatnonzero((k < top) & (size > 0)), np.flatnonzero((k > 0) & (size > 0))
        some = lambda cells: cells[np.unique(np.linspace(0, len(cells) - 1, min(len(cells), moves // 2)).astype(int))] if len(cells) else cells
        more, less = some(more), some(less)
        cell = np.concatenate([more, less])
        sign = np.concatenate([np.ones(len(more), int), -np.ones(len(less), int)])
        if not len(cell):
            break
        value = sign * size[cell]
        i, j = np.triu_indices(len(cell))
        none = np.full(len(cell), -1)
        a, b = np.concatenate([[-1], np.arange(len(cell)), i]), np.concatenate([[-1], none, j])
        total = np.where(a >= 0, value[a], 0) + np.where(b >= 0, value[b], 0)
        order = np.argsort(total, kind="stable")
        a, b, total = a[order], b[order], total[order]
        at = np.searchsorted(total, error - total)
        tries = np.concatenate([np.maximum(at - 1, 0), np.minimum(at, len(total) - 1)])
        own = np.tile(np.arange(len(total)), 2)
        gap = np.abs(error - total[own] - total[tries])
        for t in np.argsort(gap, kind="stable")[:2000].tolist():
            if gap[t] >= abs(error) - 1e-9:
                break
            made = k.copy()
            for m in (a[own[t]], b[own[t]], a[tries[t]], b[tries[t]]):
                if m >= 0:
                    made[cell[m]] += sign[m]
            if ((made >= 0) & (made <= top)).all():
                error -= float(((made - k) * size).sum())
                k = made
                break
        else:
            break
    return k


def _whole_copies(cap: float):
    """Copies for each cell, the rounding error of the larger sizes carried to the smaller ones, then exchanges."""

    def assign(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["size", "part"], ascending=[False, True], ignore_index=True)
        error = cells["target"].iloc[0] - float((cells["n"] * cells["size"] * cells["rate"]).sum()) if len(cells) else 0.0
        taken = []
        for n, size, rate in zip(cells["n"], cells["size"], cells["rate"]):
            if size:
                k = min(int(cap) * n, max(0, math.floor(n * rate + error / size + 0.5)))
                error += (n * rate - k) * size
            else:
                k = n
            taken.append(k)
        n, size = (cells[c].to_numpy(np.int64) for c in ("n", "size"))
        k = np.array(taken, np.int64)
        k = pd.Series(exchange(size, k, int(cap) * n, float(cells["target"].iloc[0]) - float((k * size).sum())), dtype="int64") if len(k) else pd.Series(k)
        return pd.DataFrame(
            {"key": cells["key"], "size": cells["size"], "part": cells["part"], "base": k // cells["n"], "extra": k % cells["n"]}
        )

    return assign


def _mixed(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    tolerance: float = 1e-6,
    rounds: int = 60,
) -> DataFrame:
    """(id, block, row_key, size, source_size, target, rate, copies) of every row: see ``mix_sources``."""
    sized = cut_lineage(
        docs.select(
            F.col(id).alias("id"),
            _key(source).alias("key"),
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            F.spark_partition_id().alias("block"),
            blocks.row_key(id, text).alias("row_key"),
        )
    )
    cells = blocks.cut(sized.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    totals = cells.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = blocks.cut(source_targets(totals, weights, share, cap))
    tilts = solve_tilts(cells.where("size > 0").drop("source"), goals, float(cap), tolerance, rounds)

    hot = cells.where(F.col("n") > CELL).select("key", "size", F.ceil(F.col("n") / CELL).alias("parts"))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("long")
    placed = sized.join(hot, ["key", "size"], "left").select("id", "key", "size", "block", "row_key", part.alias("part"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(
        _rate(F.col("tilt"), F.col("size").cast("double"), F.col("mean"), float(cap))
    )
    quotas = (
        placed.groupBy("key", "size", "part")
        .agg(F.count("*").alias("n"))
        .join(goals.select("key", "target"), "key")
        .join(tilts.select("key", "mean", "tilt"), "key", "left")
        .withColumn("rate", rate)
        .select("key", "size", "part", "n", "target", "rate")
        .groupBy("key")
        .applyInPandas(_whole_copies(cap), "key string, size long, part long, base long, extra long")
    )
    ranked = placed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("id"), "id", "row_key"))
    )
    copies = F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")
    return (
        ranked.join(quotas, ["key", "size", "part"])
        .join(goals, "key")
        .join(tilts.select("key", "mean", "tilt"), "key", "left")
        .select(
            "id", "block", "row_key", "size", "source_size", "target", rate.alias("rate"), copies.alias("copies")
        )
    )


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    tolerance: float = 1e-6,
    rounds: int = 60,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, rate, copies.

    ``rate`` is the tilted rate, ``copies`` a whole number from 0 to ``cap``, ``taken`` = copies x
    size. Per source the rounding error runs from the largest to the smallest cells, and what is left is made
    smaller by exchanges: in the end one copy more or less of any document, or of two, brings the
    taken words no closer to the target (of two among 200 sizes, see ``exchange``). Which documents of a cell get the extra copy follows from a hash of the id, so reruns
    agree. Texts without words and null texts have size 0 and one copy; a null source is a source.
    One task sees the cells of one source: one row per different size, and one more per ``CELL``
    documents of a size; a cell of many documents is ranked in parts of about ``CELL`` rows.
    An empty table gives an empty table; other columns are not looked at.
    """
    rows = _mixed(docs, id, text, source, weights, share, cap, tolerance, rounds)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select(F.col("id").alias(id), "size", "source_size", "target", taken, "rate", "copies")


def take_mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    tolerance: float = 1e-6,
    rounds: int = 60,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them. ``docs`` is a stored table."""
    rows = _mixed(docs, id, text, source, weights, share, cap, tolerance, rounds)
    return blocks.repeat_rows(docs, rows.where("copies > 0").select("block", "row_key", "copies"), id, text)
