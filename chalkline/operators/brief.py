"""The daily and weekly programme brief.

Every panel works on cohort facts: rows ``(user_id, unit, d, kind, n)`` of cohort teachers with the
local day and the number of events. ``brief_facts`` builds them once; the caller may persist them for all panels. Counts of
distinct teachers come from one row per (window, teacher), never from raw rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.dates import window_before, window_for
from chalkline.functions.maths import half_even, rate_or_null
from chalkline.operators.filters import in_days
from chalkline.operators.joins import day_spine
from chalkline.operators.percentiles import exact_percentiles

UNMAPPED = "No unit recorded"
PANELS = ("lps", "coach", "reading")
TEACHERS = {"lps": "lp_teachers", "coach": "coach_teachers", "reading": "reading_teachers"}

# Observations expected of an observer per brief.
TARGETS = {"daily": 2, "weekly": 10}


def _day(day: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def _lit(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def brief_facts(
    cohort: DataFrame,
    sources: Mapping[str, tuple[DataFrame, str, Column | None]],
    lo: dt.date | str,
    hi: dt.date | str,
    tz: str = "UTC",
) -> DataFrame:
    """Facts of cohort teachers in ``[lo, hi]``: rows (user_id, d, kind, n, unit), ``n`` events each.
    ``sources`` maps a kind to (table, time column, condition). Events are counted before they meet
    the cohort, so a very active teacher brings one row per day and kind."""
    out = None
    for kind, (df, ts, condition) in sources.items():
        if condition is not None:
            df = df.filter(condition)
        part = in_days(df, ts, str(lo), str(hi), tz).select("user_id", "d", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    counted = out.groupBy("user_id", "d", "kind").agg(F.count("*").alias("n"))
    return counted.join(cohort.select(F.col("id").alias("user_id"), "unit"), "user_id")


def _events(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _panel_counts(facts: DataFrame, panels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events and distinct teachers per panel, and active teachers, by ``keys``.

    ``facts`` are the activity facts and ``panels`` the panel facts (kinds of ``PANELS``)."""
    kinds = panels.withColumn("_active", F.lit(0)).unionByName(facts.withColumn("_active", F.lit(1)))
    per_user = kinds.groupBy(*keys, "user_id").agg(
        *[_events((F.col("kind") == p) & (F.col("_active") == 0)).alias(f"_{p}") for p in PANELS],
        F.max("_active").alias("_a"),
    )
    aggs = []
    for p in PANELS:
        aggs += [F.sum(f"_{p}").alias(p), F.count_if(F.col(f"_{p}") > 0).alias(TEACHERS[p])]
    return per_user.groupBy(*keys).agg(*aggs, F.sum("_a").alias("active"))


COLUMNS = [c for p in PANELS for c in (p, TEACHERS[p])] + ["active"]


def brief_daily(activity: DataFrame, panels: DataFrame, day: dt.date | str) -> DataFrame:
    """14 dense days with events and teachers per panel and active teachers."""
    day = _day(day)
    lo = day - dt.timedelta(days=13)
    counts = _panel_counts(activity, panels, ["d"])
    spine = day_spine(activity.sparkSession, str(lo), str(day), "d")
    return spine.join(counts, "d", "left").fillna(0, COLUMNS)


def brief_daily_by_unit(panels: DataFrame, cohort: DataFrame, day: dt.date | str, most: int = 8) -> DataFrame:
    """Teachers per day and unit for plans and coaching, only when there are at most ``most``
    units (else no rows). A missing unit is named."""
    day = _day(day)
    named = F.coalesce("unit", F.lit(UNMAPPED)).alias("unit")
    units = cohort.select(named).distinct()
    few = units.agg((F.count("*") <= most).alias("_few"))
    per_user = panels.select("user_id", "d", "kind", named).groupBy("d", "unit", "user_id").agg(
        F.max((F.col("kind") == "lps").cast("int")).alias("l"), F.max((F.col("kind") == "coach").cast("int")).alias("c")
    )
    counts = per_user.groupBy("d", "unit").agg(F.sum("l").alias("lp_teachers"), F.sum("c").alias("coach_teachers"))
    spine = day_spine(panels.sparkSession, str(day - dt.timedelta(days=13)), str(day), "d")
    grid = units.crossJoin(F.broadcast(few)).filter("_few").drop("_few").crossJoin(F.broadcast(spine))  # 14 days
    return grid.join(counts, ["d", "unit"], "left").fillna(0, ["lp_teachers", "coach_teachers"])


def brief_weekly(activity: DataFrame, panels: DataFrame, day: dt.date | str) -> DataFrame:
    """Eight trailing weeks, ``k`` weeks before the one that ends on ``day``."""
    day = _day(day)
    week = F.floor(F.datediff(_lit(day), F.col("d")) / 7).cast("int").alias("k")
    counts = _panel_counts(activity.withColumn("k", week), panels.withColumn("k", week), ["k"])
    spine = activity.sparkSession.range(8).select(F.col("id").cast("int").alias("k"))
    return (
        spine.join(counts, "k", "left")
        .fillna(0, COLUMNS)
        .withColumns(
            {
                "week_start": F.date_sub(_lit(day), F.col("k") * 7 + 6),
                "week_end": F.date_sub(_lit(day), F.col("k") * 7),
            }
        )
    )


def _windows(lo: dt.date, hi: dt.date) -> dict[str, Column]:
    plo, phi = window_before(lo, hi)
    return {
        "": F.col("d").between(_lit(lo), _lit(hi)),
        "prev_": F.col("d").between(_lit(plo), _lit(phi)),
    }


def window_totals(panels: DataFrame, lo: dt.date | str, hi: dt.date | str) -> DataFrame:
    """Events and teachers of a window and of the equal window before, in one row."""
    spans = _windows(_day(lo), _day(hi))
    per_user = panels.groupBy("user_id").agg(
        *[
            _events(inside & (F.col("kind") == p)).alias(f"_{w}{p}")
            for w, inside in spans.items()
            for p in PANELS
        ]
    )
    aggs = []
    for w in spans:
        for p in PANELS:
            aggs.append(F.coalesce(F.sum(f"_{w}{p}"), F.lit(0)).alias(f"{w}{p}"))
            aggs.append(F.count_if(F.col(f"_{w}{p}") > 0).alias(f"{w}{TEACHERS[p]}"))
    return per_user.agg(*aggs)


def active_summary(activity: DataFrame, day: dt.date | str) -> DataFrame:
    """Teachers active on the day, the day before, in seven days and the seven before."""
    day = _day(day)

    def days(first: int, last: int) -> Column:
        return F.col("d").between(_lit(day - dt.timedelta(days=first)), _lit(day - dt.timedelta(days=last)))

    spans = {
        "active_today": days(0, 0),
        "active_yesterday": days(1, 1),
        "active_week": days(6, 0),
        "active_prev_week": days(13, 7),
    }
    per_user = activity.groupBy("user_id").agg(*[F.max(c).alias(n) for n, c in spans.items()])
    return per_user.agg(*[F.count_if(n).alias(n) for n in spans])


def _active_in_week(activity: DataFrame, day: dt.date) -> DataFrame:
    inside = F.col("d").between(_lit(day - dt.timedelta(days=6)), _lit(day))
    return activity.filter(inside).select(F.col("user_id").alias("id")).distinct().withColumn("_active", F.lit(1))


def units_summary(cohort: DataFrame, activity: DataFrame, day: dt.date | str) -> DataFrame:
    """Registered and active teachers per unit, the unmapped unit last."""
    joined = cohort.join(_active_in_week(activity, _day(day)), "id", "left")
    units = joined.groupBy("unit").agg(
        F.count("*").alias("registered"), F.coalesce(F.sum("_active"), F.lit(0)).alias("active_week")
    )
    return units.select(F.coalesce("unit", F.lit(UNMAPPED)).alias("name"), "registered", "active_week").orderBy(
        F.col("name") == UNMAPPED, F.col("registered").desc(), "name"
    )


# coaching -------------------------------------------------------------------------


def in_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    return df.join(cohort.select(F.col("id").alias("user_id")), "user_id", "left_semi")


def json_score(analysis: str = "analysis_data") -> Column:
    """Overall score from the analysis JSON; empty text and non-numbers become NULL."""
    return F.nullif(F.get_json_object(analysis, "$.scores.overall_percentage"), F.lit("")).try_cast("double")


def coaching_summary(coaching: DataFrame) -> DataFrame:
    """Over the given window rows: sessions, teachers, mean score and the most frequent
    framework (the smallest name on ties, found by counting per framework)."""
    score = json_score()
    rows = coaching.select("user_id", score.alias("s"), F.get_json_object("analysis_data", "$.framework").alias("framework"))
    parts = rows.groupBy("user_id", "framework").agg(
        F.count("*").alias("n"), F.sum("s").alias("s"), F.count("s").alias("ns")
    )
    users = parts.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ns").alias("ns"))
    totals = users.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"),
        F.count("user_id").alias("teachers"),
        F.when(F.sum("ns") > 0, F.round(F.sum("s") / F.sum("ns"), 1)).alias("avg_score"),
    )
    mode = (
        parts.filter(F.col("framework").isNotNull())
        .groupBy("framework")
        .agg(F.sum("n").alias("n"))
        .agg(F.min_by("framework", F.struct((-F.col("n")).alias("n"), "framework")).alias("framework"))
    )
    return totals.crossJoin(F.broadcast(mode))  # one row each


def score_trend(coaching: DataFrame) -> DataFrame:
    """Mean score and number of scored sessions per day ``d``."""
    scored = coaching.withColumn("_s", json_score()).filter(F.col("_s").isNotNull())
    return scored.groupBy("d").agg(F.round(F.avg("_s"), 1).alias("avg_score"), F.count("*").alias("n")).orderBy("d")


def domain_breakdown(coaching: DataFrame) -> DataFrame:
    """Mean of score over maximum per domain, weakest first. ``areas`` stands in when there are
    no ``domains``; entries without ``area_score`` are left out."""
    domains = F.coalesce(F.get_json_object("analysis_data", "$.domains"), F.get_json_object("analysis_data", "$.areas"))
    entries = coaching.select(F.explode(F.from_json(domains, "map<string,string>")).alias("key", "value"))
    known = entries.filter(F.array_contains(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), "area_score"))
    score = F.get_json_object("value", "$.area_score").try_cast("double")
    most = F.get_json_object("value", "$.area_max").try_cast("double")
    share = score / F.nullif(most, F.lit(0.0))
    return (
        known.groupBy("key")
        .agg(F.round(F.avg(share) * 100, 1).alias("pct"), F.count("*").alias("n"))
        .orderBy(F.col("pct").asc_nulls_last(), "key")
    )


# reading ----------------------------------------------------------------------------


def _on_track() -> Column:
    return rate_or_null(F.count_if("on_track"), F.count("on_track"), 1)


def reading_summary(reading: DataFrame) -> DataFrame:
    """Assessments, distinct students (the row id when unnamed) and on-track share."""
    student = F.coalesce("student_identifier", F.col("id").cast("string"))
    per_student = reading.groupBy(student.alias("student")).agg(
        F.count("*").alias("n"), F.count_if("on_track").alias("yes"), F.count("on_track").alias("known")
    )
    return per_student.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("assessments"),
        F.count("*").alias("students"),
        rate_or_null(F.sum("yes"), F.sum("known"), 1).alias("on_track_pct"),
    )


def reading_by_grade(reading: DataFrame) -> DataFrame:
    """Per grade the number, the median rate and the on-track share."""
    counts = reading.groupBy("grade_level").agg(F.count("*").alias("n"), _on_track().alias("on_track_pct"))
    median = exact_percentiles(reading, ["grade_level"], "wcpm", {"m": (0.5, "cont")})
    return counts.join(
        median.select(F.col("grade_level").alias("_g"), F.round("m", 1).alias("median_wcpm")),
        F.col("grade_level").eqNullSafe(F.col("_g")),
        "left",
    ).drop("_g")


# features, units, observers -------------------------------------------------------------


def feature_strip(facts: DataFrame, lo: dt.date | str, hi: dt.date | str) -> DataFrame:
    """Uses per kind in the window and in the window before."""
    spans = _windows(_day(lo), _day(hi))
    return facts.groupBy("kind").agg(
        _events(spans[""]).alias("n"), _events(spans["prev_"]).alias("prev")
    )


def unit_attention(cohort: DataFrame, activity: DataFrame, day: dt.date | str) -> DataFrame:
    """Every unit with registered and active teachers, worst share first; halves round to even.
    Teachers without a unit are not a unit here (see ``unmapped_teachers``)."""
    joined = cohort.filter(F.col("unit").isNotNull()).join(_active_in_week(activity, _day(day)), "id", "left")
    return (
        joined.groupBy("unit")
        .agg(F.count("*").alias("registered"), F.count("_active").alias("active_7d"))
        .withColumn("pct", half_even(F.col("active_7d") * 100 / F.col("registered")).cast("int"))
        .orderBy("pct", F.col("registered").desc(), "unit")
    )


def unmapped_teachers(cohort: DataFrame) -> DataFrame:
    """Number of teachers without a unit."""
    return cohort.agg(F.count_if(F.col("unit").isNull()).alias("unmapped_teachers"))


def observer_targets(observations: DataFrame, cohort: DataFrame, day: dt.date | str, kind: str) -> DataFrame:
    """Everyone who ever observed a cohort teacher, with their observations in the window
    (zeros kept) and whether they hit or passed the target. ``observations(user_id,
    observer_user_id, d)``; the observers' own counts are not limited to the cohort."""
    lo, hi = window_for(_day(day), kind)
    seen = observations.filter(F.col("observer_user_id").isNotNull())
    roster = in_cohort(seen, cohort).select("observer_user_id").distinct()
    counts = (
        seen.filter(F.col("d").between(_lit(lo), _lit(hi))).groupBy("observer_user_id").agg(F.count("*").alias("n"))
    )
    target = TARGETS[kind]
    return (
        roster.join(counts, "observer_user_id", "left")
        .fillna(0, ["n"])
        .withColumns({"hit": F.col("n") >= target, "above": F.col("n") > target})
    )


def observer_summary(targets: DataFrame, working_days: int) -> DataFrame:
    """Roster size, hits and passes."""
    return targets.agg(
        F.count("*").alias("roster_size"),
        F.count_if("hit").alias("hit"),
        F.count_if("above").alias("above"),
        F.lit(working_days).alias("working_days"),
    )


def delta(cur: Column, prev: Column, mode: str = "count") -> Column:
    """Change as text. Percentages compare in points; counts absolutely when either side is
    below 20, else in percent; halves round to even."""
    a, b = cur.cast("double"), prev.cast("double")

    def signed(x: Column, unit: str) -> Column:
        arrow = F.when(x > 0, "▲ ").otherwise("▼ ")
        return F.concat(arrow, F.abs(x).cast("bigint").cast("string"), F.lit(unit))

    if mode == "pct":
        points = half_even(a - b)
        text = F.when(points == 0, "no change").otherwise(signed(points, "pt"))
    elif mode == "count":
        small = (a < 20) | (b < 20)
        text = (
            F.when(a == b, "no change")
            .when(small, signed(half_even(a - b), ""))
            .otherwise(signed(half_even((a - b) * 100 / b), "%"))
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(a.isNull() | b.isNull(), "no earlier data").otherwise(text)
