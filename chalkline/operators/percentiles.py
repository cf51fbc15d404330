"""Exact percentiles of groups of any size (N4, used by A25 and A30).

The built-in exact aggregates hold every distinct value of a group in one
buffer. Here distinct values are counted first, summed into bins between
approximate quantiles of the group's distinct values, so that a bin holds about
as many of them as any other wherever they lie, and only the bins that hold a
wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: bins per group, in rows of STEP for a search in two steps
BINS, STEP = 1024, 32


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, tuple[float, str]],
    weight: str | None = None,
) -> DataFrame:
    """One row per key with ``n`` and one column per entry of ``wanted``.

    ``wanted`` maps a column name to ``(p, "cont" | "disc")`` with the SQL meaning of
    ``percentile_cont`` and ``percentile_disc``. NULL values are ignored. ``weight`` names a column
    with the number of times a row counts.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        (F.sum(weight) if weight else F.count("*")).alias("_n")
    )
    shares = F.array(*[F.lit(i / BINS) for i in range(BINS)])
    bounds = counted.groupBy(*keys).agg(
        F.percentile_approx("_v", shares, F.lit(8 * BINS)).alias("_cuts"), F.sum("_n").alias("_total")
    )
    keyed = [F.col(k) for k in keys]

    def attach(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        if not on:
            return left.crossJoin(F.broadcast(right))  # without keys there is one group
        renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on])
        cond = F.lit(True)
        for k in on:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return left.join(renamed, cond).drop(*[f"_r_{k}" for k in on])

    below = lambda part: F.size(F.filter(part, lambda cut: cut < F.col("_v")))
    tops = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1), F.lit(STEP)), lambda i: F.get(F.col("_cuts"), i))
    binned = (
        attach(counted, bounds.withColumn("_tops", tops), keys)
        .withColumn("_row", below(F.col("_tops")))
        .withColumn(
            "_bin",
            F.when(F.col("_row") == 0, 0).otherwise(
                (F.col("_row") - 1) * STEP + 1 + below(F.slice("_cuts", (F.col("_row") - 1) * STEP + 2, F.lit(STEP - 1)))
            ),
        )
        .drop("_cuts", "_tops", "_row")
    )
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_total"))
        .withColumn("_bend", F.sum("_bn").over(order))
        .withColumn("_bstart", F.col("_bend") - F.col("_bn"))
    )

    def ranks(p: float, method: str):
        total = F.col("_total")
        if method == "disc":
            rank = F.greatest(F.ceil(F.lit(p) * total), F.lit(1)) - 1
            return [rank]
        exact = F.lit(p) * (total - 1)
        return [F.floor(exact), F.ceil(exact)]

    hits = F.lit(False)
    for p, method in wanted.values():
        for rank in ranks(p, method):
            hits = hits | ((rank >= F.col("_bstart")) & (rank < F.col("_bend")))
    target = bins.filter(hits).select(*keyed, "_bin", "_bstart")
    near = attach(binned, target, [*keys, "_bin"])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_end", F.col("_bstart") + F.sum("_n").over(inside)).withColumn(
        "_start", F.col("_end") - F.col("_n")
    )
    picks = []
    for name, (p, method) in wanted.items():
        at = [
            F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))
            for rank in ranks(p, method)
        ]
        if method == "disc":
            picks.append(at[0].alias(name))
        else:
            share = F.max(F.lit(p) * (F.col("_total") - 1) - F.floor(F.lit(p) * (F.col("_total") - 1)))
            picks.append((at[0] + (at[1] - at[0]) * share).alias(name))
    return placed.groupBy(*keys).agg(F.max("_total").alias("n"), *picks)
