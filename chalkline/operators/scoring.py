"""Per-record scoring and summaries."""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.maths import attendance_pct, half_up, rate_or_null, whole_pct
from chalkline.operators.joins import grade_scale_join
from chalkline.operators.percentiles import exact_percentiles


# A30 ------------------------------------------------------------------------------


def latency_percentiles(plans: DataFrame, as_of: str, hours: int = 168) -> DataFrame:
    """Discrete p50 and p90 of positive latencies per source in the look-back."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOUR")
    recent = plans.filter((F.col("delivery_time_ms") > 0) & (F.col("created_at") > since))
    found = exact_percentiles(
        recent, ["source"], "delivery_time_ms", {"p50_ms": (0.5, "disc"), "p90_ms": (0.9, "disc")}
    )
    return found.withColumnRenamed("n", "sample_size")


def expected_wait(stats: DataFrame, default_sec: int, default_upper_sec: int, enough: int = 10) -> DataFrame:
    """Waiting times shown to users; below ``enough`` samples the defaults hold."""
    live = (F.col("sample_size") >= enough) & (F.col("p50_ms") > 0) & (F.col("p90_ms") > 0)
    expected = F.when(live, half_up(F.col("p50_ms") / 1000)).otherwise(default_sec)
    upper = F.when(live, half_up(F.col("p90_ms") / 1000)).otherwise(default_upper_sec)
    return stats.withColumns(
        {
            "expected_min": F.greatest(F.lit(1), half_up(expected / 60)).cast("int"),
            "upper_min": F.greatest(F.lit(2), half_up(upper / 60)).cast("int"),
        }
    )


# A31, A32 -----------------------------------------------------------------------------


def attendance_summary(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Per list the sessions, the mean of the sessions' percentages, present and absent totals."""
    share = F.when(F.col("total_students") > 0, F.col("present_count").cast("double") / F.col("total_students") * 100).otherwise(0.0)
    return (
        sessions.filter(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("list_id")
        .agg(
            F.count("*").alias("total_sessions"),
            F.round(F.avg(share), 2).alias("avg_attendance_percentage"),
            F.sum("present_count").alias("total_present"),
            F.sum("absent_count").alias("total_absent"),
        )
    )


def session_percentages(sessions: DataFrame) -> DataFrame:
    """Attendance percentage of each session."""
    return sessions.withColumn("attendance_pct", attendance_pct(F.col("present_count"), F.col("total_students")))


def _month_marks(records: DataFrame, year: int, month: int) -> DataFrame:
    first = dt.date(year, month, 1)
    last = dt.date(year, month, calendar.monthrange(year, month)[1])
    inside = records.filter(
        F.col("session_date").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))
    )
    mark = F.when(F.col("status") == "present", "P").otherwise("A")
    return inside.groupBy("list_id", "student_id", F.dayofmonth("session_date").alias("day")).agg(
        F.max_by(mark, F.struct("recorded_at", "status")).alias("mark")
    )


def attendance_register(students: DataFrame, records: DataFrame, year: int, month: int) -> DataFrame:
    """One row per student with a column per day of the month, the last mark of a day, present,
    absent and rounded percentage. Marks are reduced to one per student and day first."""
    days = list(range(1, calendar.monthrange(year, month)[1] + 1))
    marks = _month_marks(records, year, month)
    wide = marks.groupBy("student_id").pivot("day", days).agg(F.first("mark"))
    wide = wide.withColumnsRenamed({str(d): f"d{d:02d}" for d in days})
    names = [f"d{d:02d}" for d in days]
    joined = students.join(wide, "student_id", "left")

    def times(letter: str) -> Column:
        return sum((F.coalesce((F.col(n) == letter).cast("int"), F.lit(0)) for n in names), F.lit(0))

    return joined.withColumns({"present": times("P"), "absent": times("A")}).withColumn(
        "percentage", whole_pct(F.col("present"), F.col("present") + F.col("absent"))
    )


def register_day_totals(records: DataFrame, year: int, month: int) -> DataFrame:
    """Per list and day the present and absent counts and whether it is a weekend."""
    day = F.make_date(F.lit(year), F.lit(month), F.col("day"))
    return (
        _month_marks(records, year, month)
        .groupBy("list_id", "day")
        .agg(F.count_if(F.col("mark") == "P").alias("present"), F.count_if(F.col("mark") == "A").alias("absent"))
        .withColumn("is_weekend", F.weekday(day) >= 5)
    )


# A33 - A35 ------------------------------------------------------------------------------


def video_quiz_popularity(deliveries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per day, grade and subject what happened to the quizzes sent with videos."""
    status = sessions.select(F.col("session_id").alias("quiz_session_id"), F.col("status").alias("_status"))
    # deliveries without a session match none, and as equal keys would all go to one task
    has = F.col("quiz_session_id").isNotNull()
    joined = deliveries.filter(has).join(status, "quiz_session_id", "left")
    joined = joined.unionByName(deliveries.filter(~has).withColumn("_status", F.lit(None).cast(status.schema["_status"].dataType)))
    answer = F.col("quiz_response")
    return (
        joined.groupBy(F.to_date("delivered_at").alias("day"), "grade", "subject")
        .agg(
            F.count("*").alias("videos_sent"),
            F.count("quiz_offered_at").alias("quizzes_offered"),
            F.count_if(answer == "accepted").alias("quizzes_started"),
            F.count_if(F.col("_status") == "completed").alias("quizzes_completed"),
            F.count_if(answer == "declined").alias("quizzes_declined"),
            F.count_if(answer == "ignored").alias("offers_ignored"),
        )
        .withColumn("accept_rate_pct", rate_or_null(F.col("quizzes_started"), F.col("quizzes_offered"), 1))
    )


def ab_event_counts(events: DataFrame) -> DataFrame:
    """Impressions, conversions and bounces per variant; a conversion is a success, a bounce a failure."""
    kind = F.col("event_type")
    counts = events.groupBy("test_id", "variant_name").agg(
        F.count_if(kind == "impression").alias("impressions"),
        F.count_if(kind == "conversion").alias("conversions"),
        F.count_if(kind == "bounce").alias("bounces"),
    )
    return counts.withColumns({"successes": F.col("conversions"), "failures": F.col("bounces")})


def wilson_stats(variants: DataFrame, z: float = 1.96) -> DataFrame:
    """Conversion rate and the 95 % Wilson interval within [0, 1]; all 0 without impressions."""
    n = F.coalesce("impressions", F.lit(0))
    p = F.col("conversions") / n
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    spread = F.lit(z) * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / base
    some = n > 0
    return variants.withColumns(
        {
            "conversion_rate": F.when(some, F.round(p * 100, 2)).otherwise(0.0),
            "wilson_lower": F.when(some, F.greatest(F.lit(0.0), centre - spread)).otherwise(0.0),
            "wilson_upper": F.when(some, F.least(F.lit(1.0), centre + spread)).otherwise(0.0),
        }
    )


DRAW_BLOCK = 1000


def win_probabilities(variants: DataFrame, draws: int = 10_000) -> DataFrame:
    """Share of draws in which a variant has the highest Beta sample of its test.

    A variant is sent once per block of DRAW_BLOCK draws, as its two parameters; the draws are made where the
    variants of a test and block meet, seeded by test, variant and block, so a retried task repeats the
    same numbers. They come in order of their names, and one running best per draw is all that a task holds, however
    many variants a test has. A single variant wins always; ties go to the smaller name."""

    def prior(column: str) -> Column:
        return F.when(F.coalesce(column, F.lit(0)) == 0, 1).otherwise(F.col(column)).cast("double")

    params = variants.select(
        F.col("test_id").cast("string"), "variant_name", prior("successes").alias("alpha"), prior("failures").alias("beta")
    )

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = best = names = None

        def wins() -> pd.DataFrame:
            won = pd.Series(names).value_counts(dropna=False)
            return pd.DataFrame({"test_id": group[0], "variant_name": won.index, "wins": won.to_numpy()})

        for batch in batches:
            for row in batch.itertuples(index=False):
                size = min(DRAW_BLOCK, draws - row.block * DRAW_BLOCK)
                if group != (row.test_id, row.block):
                    if group is not None:
                        yield wins()
                    group, best, names = (row.test_id, row.block), np.full(size, -1.0), np.empty(size, object)
                digest = hashlib.sha256(f"{row.test_id}|{row.variant_name}|{row.block}".encode()).digest()
                values = np.random.default_rng(int.from_bytes(digest[:8], "big")).beta(row.alpha, row.beta, size)
                ahead = values > best
                best[ahead], names[ahead] = values[ahead], row.variant_name
        if group is not None:
            yield wins()

    blocks = F.sequence(F.lit(0), F.lit((draws - 1) // DRAW_BLOCK))
    entered = params.withColumn("block", F.explode(blocks)).repartition("test_id", "block")
    entered = entered.sortWithinPartitions("test_id", "block", "variant_name")
    won = entered.mapInPandas(play, "test_id string, variant_name string, wins long")
    wins = won.groupBy("test_id", "variant_name").agg(F.sum("wins").alias("_wins"))
    return (
        params.select("test_id", "variant_name")
        .join(wins, ["test_id", "variant_name"], "left")
        .select("test_id", "variant_name", (F.coalesce("_wins", F.lit(0)) / draws).alias("win_probability"))
    )


def ab_variant_stats(variants: DataFrame, draws: int = 10_000) -> DataFrame:
    """Wilson columns and win probability per variant."""
    keyed = variants.withColumn("test_id", F.col("test_id").cast("string"))
    return wilson_stats(keyed).join(win_probabilities(variants, draws), ["test_id", "variant_name"])


# A36, A37 ----------------------------------------------------------------------------------

# Languages that count, and codes mapped to a regional one.
LANGUAGES = [
    "en", "ur", "pa-PK", "sd-PK", "ps-PK", "bal-PK", "ta-LK", "hi", "bn", "mr", "te", "ta-IN", "kn", "ar", "es", "fr",
]
REGIONAL = {"pa": "pa-PK", "ps": "ps-PK", "sd": "sd-PK", "ta": "ta-LK", "bal": "bal-PK"}


def language_stats(users: DataFrame, default: str = "en") -> DataFrame:
    """Users per preferred language; none or blank counts as the default."""
    language = F.coalesce(F.nullif("preferred_language", F.lit("")), F.lit(default))
    return users.groupBy(language.alias("language")).agg(F.count("*").alias("users"))


def normalize_language(code: Column) -> Column:
    low = F.lower(code)
    base = F.substring_index(low, "-", 1)
    pairs = [F.lit(x) for pair in REGIONAL.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[base], F.when(low.isin(LANGUAGES), low), base)


def _language_counts(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens per transcript and known language; the others count under NULL."""
    code = normalize_language(F.nullif("language", F.lit("")))
    return tokens.groupBy(key, F.when(code.isin(LANGUAGES), code).alias("language")).agg(F.count("*").alias("count"))


def language_distribution(tokens: DataFrame, key: str = "session_id") -> DataFrame:
    """Tokens per known language and their share per transcript."""
    known = _language_counts(tokens, key).filter(F.col("language").isNotNull())
    whole = F.sum("count").over(Window.partitionBy(key))  # at most one row per language
    return known.withColumn("share", F.col("count") / whole)


def dominant_language(tokens: DataFrame, key: str = "session_id", threshold: float = 0.5) -> DataFrame:
    """The language with more than half of the known tokens, else NULL, and the top share.
    Transcripts without known tokens keep a row with share 0."""
    known = F.col("language").isNotNull()
    tops = _language_counts(tokens, key).groupBy(key).agg(
        F.sum("count").alias("total_tokens"),
        (F.max(F.when(known, F.col("count"))) / F.sum(F.when(known, F.col("count")))).alias("_share"),
        F.min(F.when(known, F.struct((-F.col("count")).alias("n"), "language"))).alias("_best"),
    )
    return tops.select(
        key,
        "total_tokens",
        F.coalesce("_share", F.lit(0.0)).alias("confidence"),
        F.when(F.col("_share") > threshold, F.col("_best.language")).alias("language"),
    )


def usage_costs(usage: DataFrame, as_of: str, limits: dict[str, float], prices: dict[str, float]) -> DataFrame:
    """Units, calls, cost and projected cost per service since the start of the month, with a
    status at 75 and 90 % of the limit. ``limits`` are in units; a service without price costs its
    logged sum."""
    start = F.date_trunc("month", F.lit(as_of).cast("timestamp"))

    def lookup(table: dict[str, float]) -> Column:
        if not table:
            return F.lit(None).cast("double")
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("service")]

    sums = (
        usage.filter(F.col("created_at") >= start)
        .groupBy("service")
        .agg(F.sum("units").alias("units"), F.sum("cost").alias("logged"), F.count("*").alias("calls"))
    )
    pct = F.col("units") / lookup(limits) * 100
    cost = F.coalesce(F.col("units") * lookup(prices), F.col("logged"), F.lit(0.0))
    return sums.select(
        "service",
        "units",
        "calls",
        F.round(cost, 2).alias("cost"),
        F.round(cost * 2, 2).alias("projected_cost"),
        F.round(F.least(pct, F.lit(100.0)), 2).alias("percentage"),
        F.when(pct >= 90, "critical").when(pct >= 75, "warning").otherwise("healthy").alias("status"),
    )


# A39 - A41 ------------------------------------------------------------------------------------


def reading_overview(reading: DataFrame) -> DataFrame:
    """Per user the completed assessments, mean rate and accuracy (missing as 0), distinct
    students (unnamed ones as one) and the newest row."""
    done = reading.filter(F.col("status") == "completed")

    def exact(column: str) -> Column:
        # a decimal sum does not depend on the order in which partial sums arrive
        return F.sum(F.coalesce(column, F.lit(0.0)).cast("decimal(24,6)")).cast("double")

    per_student = done.groupBy("user_id", "student_identifier").agg(
        F.count("*").alias("n"),
        exact("wcpm").alias("w"),
        exact("accuracy").alias("a"),
        F.max(F.struct("created_at", "id")).alias("last"),
    )
    tenth = lambda x: half_up(x * 10) / 10
    return per_student.groupBy("user_id").agg(
        F.sum("n").alias("total_assessments"),
        tenth(exact("w") / F.sum("n")).alias("average_wcpm"),
        tenth(exact("a") / F.sum("n")).alias("average_accuracy"),
        F.count("*").alias("students_assessed"),
        F.max("last")["id"].alias("latest_id"),
        F.max("last")["created_at"].alias("latest_at"),
    )


def reading_trend(reading: DataFrame) -> DataFrame:
    """Completed assessments as ascending trend points, missing values as 0."""
    return (
        reading.filter(F.col("status") == "completed")
        .select(
            "user_id",
            "id",
            F.col("created_at").alias("date"),
            F.coalesce("wcpm", F.lit(0.0)).alias("wcpm"),
            F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
            F.col("student_identifier").alias("student_name"),
        )
        .orderBy("user_id", "date", "id")
    )


# Goals of the coaching portal as (stored total, name, highest marks).
PORTAL_GOALS = [
    ("goal1_total", "Formative Assessment", 22),
    ("goal2_total", "Student Engagement", 22),
    ("goal3_total", "Quality Content", 38),
    ("goal4_total", "Effective Differentiation", 5),
    ("goal5_total", "Classroom Management", 21),
    ("debrief_total", "Reflective Debrief", 15),
]


def _stored(path: str) -> Column:
    value = F.get_json_object("analysis_data", path).try_cast("double")
    return F.when(value != 0, value)


def coaching_overview(sessions: DataFrame) -> DataFrame:
    """Per user the number of completed sessions, mean score, last minus first score and the best
    and weakest goal of the newest session (the first and last named win ties)."""
    score = F.coalesce(_stored("$.scores.overall_marks"), _stored("$.scores.grand_total"), F.lit(0.0))
    at = F.struct("created_at", "id")
    done = sessions.filter(F.col("status") == "completed").withColumn("_score", score)
    per_user = done.groupBy("user_id").agg(
        F.count("*").alias("total_sessions"),
        (half_up(F.avg("_score") * 10) / 10).alias("average_score"),
        (half_up((F.max_by("_score", at) - F.min_by("_score", at)) * 10) / 10).alias("improvement"),
        F.max_by("analysis_data", at).alias("analysis_data"),
    )
    goals = F.array(
        *[
            F.struct(
                (half_up(F.coalesce(_stored(f"$.scores.{field}"), F.lit(0.0)) / most * 1000) / 10).alias("pct"),
                F.lit(-i).alias("rank"),
                F.lit(name).alias("name"),
            )
            for i, (field, name, most) in enumerate(PORTAL_GOALS)
        ]
    )
    return per_user.withColumn("_goals", goals).select(
        "user_id",
        "total_sessions",
        "average_score",
        "improvement",
        F.array_max("_goals")["name"].alias("best_goal"),
        F.array_min("_goals")["name"].alias("focus_goal"),
    )


def job_durations(sessions: DataFrame) -> DataFrame:
    """Whole, transcription and analysis seconds and the summed cost of each session."""

    def seconds(start: str, end: str) -> Column:
        return half_up((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("bigint")

    costs = [c for c in ("transcription_cost", "analysis_cost", "report_cost", "voice_cost") if c in sessions.columns]
    return sessions.select(
        "id",
        seconds("created_at", "completed_at").alias("processing_seconds"),
        seconds("transcription_started_at", "transcription_completed_at").alias("transcription_seconds"),
        seconds("analysis_started_at", "analysis_completed_at").alias("analysis_seconds"),
        sum((F.coalesce(c, F.lit(0)) for c in costs), F.lit(0)).alias("total_cost"),
    )


# A42 --------------------------------------------------------------------------------------------


def exam_totals(grades: DataFrame, board: str | Column = "board") -> DataFrame:
    """Marks, maximum, rounded percentage and board grade per submission."""
    totals = grades.groupBy("submission_id", "class_id", "board").agg(
        F.sum(F.coalesce("max_marks", F.lit(0))).alias("total_marks"),
        F.sum(F.coalesce("awarded_marks", F.lit(0))).alias("marks_awarded"),
    )
    return grade_scale_join(
        totals.withColumn("percentage", whole_pct(F.col("marks_awarded"), F.col("total_marks"))), "percentage", board
    )


def class_summary(results: DataFrame) -> DataFrame:
    """Mean, best and worst percentage per class."""
    return results.groupBy("class_id").agg(
        F.count("*").alias("students"),
        half_up(F.avg("percentage")).cast("bigint").alias("average_percentage"),
        F.max("percentage").alias("highest_score"),
        F.min("percentage").alias("lowest_score"),
    )


def grade_distribution(results: DataFrame) -> DataFrame:
    """Students per class and grade."""
    return results.groupBy("class_id", "grade").agg(F.count("*").alias("students"))


def keyword_marks(answers: DataFrame, expected: str = "correct_answer", given: str = "student_answer", marks: str = "marks") -> DataFrame:
    """Partial marks by the share of expected words (longer than three letters) in the answer."""

    def words(column: str) -> Column:
        return F.array_distinct(
            F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"\s+"), lambda w: F.length(w) > 3)
        )

    split = answers.withColumns({"_want": words(expected), "_have": words(given)})
    most = F.when(F.coalesce(marks, F.lit(0)) == 0, 1).otherwise(F.col(marks))
    ratio = F.when(F.size("_want") > 0, F.size(F.array_intersect("_want", "_have")) / F.size("_want")).otherwise(0.0)
    return split.withColumns(
        {"match_ratio": ratio, "marks_awarded": half_up(ratio * most).cast("bigint")}
    ).drop("_want", "_have")
