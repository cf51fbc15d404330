"""W: window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.rows import inline_into
from chalkline.functions.text import SCORE_PATHS, json_pick
from chalkline.operators.ordered import (
    carry_lag,
    number_rows,
    position_chunk,
    running_total,
    time_chunk,
    top_n,
    with_neighbours,
)
from chalkline.operators.sets import word_counts


def sessionize(events: DataFrame, user: str, ts: str, tie: str, gap_minutes: int = 30) -> DataFrame:
    """Number the sessions of each user; a gap strictly longer than ``gap_minutes`` opens one.

    Every user is cut into hours. Gaps are found inside each hour; a table with one row per user and
    hour (first, last, gaps inside) tells which hours open with a new session and how many came
    before. The events are shuffled once in full and once with two columns for that table."""
    gap = gap_minutes * 60_000_000

    def longer(later: Column, earlier: Column) -> Column:
        return F.unix_micros(later) - F.unix_micros(earlier) > gap

    def with_gaps(df: DataFrame) -> DataFrame:
        opens = F.coalesce(longer(F.col(ts), F.lag(ts).over(order)), F.lit(False)).cast("int")
        return df.withColumn("_opens", opens)

    # user and hour as one value that is never NULL: window and join need one shuffle together
    order = Window.partitionBy("_g").orderBy(ts, tie)
    rows = events.withColumn("_g", F.struct(F.col(user).alias("user"), time_chunk(ts).alias("hour")))
    hours = with_gaps(rows.select("_g", ts, tie)).groupBy("_g").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_opens").alias("_inside")
    )
    across = Window.partitionBy("_g.user").orderBy("_g.hour")
    starts = F.when(F.lag("_last").over(across).isNull(), 1).otherwise(
        longer(F.col("_first"), F.lag("_last").over(across)).cast("int")
    )
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    numbered = hours.withColumn("_starts", starts).select(
        "_g",
        (F.coalesce(F.sum(F.col("_starts") + F.col("_inside")).over(before), F.lit(0)) + F.col("_starts")).alias("_base"),
    )
    placed = with_gaps(rows).withColumn(
        "_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        placed.join(numbered, "_g")
        .withColumn("session_no", F.col("_base") + F.col("_run"))
        .drop("_base", "_run", "_opens", "_g")
        .withColumnsRenamed({user: "user_id", ts: "created_at"})
    )


def sessions(numbered: DataFrame) -> DataFrame:
    """One row per session with start, last event and size."""
    return numbered.groupBy("user_id", "session_no").agg(
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("ended_at"),
        F.count("*").alias("message_count"),
    )


def session_totals(session_rows: DataFrame) -> DataFrame:
    """Rows, sessions and users in one row, from the session table."""
    per_user = session_rows.groupBy("user_id").agg(
        F.sum("message_count").alias("m"), F.count("*").alias("s")
    )
    return per_user.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("total_conversations"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("sessions_created"),
        F.count("*").alias("users_processed"),
    )


# W2, W3, W11 ---------------------------------------------------------------------------


def latest_scores(sessions: DataFrame, n: int = 10, exclude=None) -> DataFrame:
    """Scores of the newest ``n`` completed sessions per user with their place from oldest to
    newest. ``exclude`` is one session id left out after the cut; rows without a number are dropped."""
    recent = top_n(
        sessions.filter(F.col("status") == "completed"),
        ["user_id"],
        [F.col("created_at").desc(), F.col("id").desc()],
        n,
        "newest",
    )
    if exclude is not None:
        recent = recent.filter(F.col("id") != exclude)
    scored = recent.withColumn("pct", json_pick(F.col("analysis_data"), *SCORE_PATHS)).filter(F.col("pct").isNotNull())
    return scored.select(
        "user_id", "id", "created_at", "newest", "pct", F.get_json_object("analysis_data", "$.framework").alias("framework")
    )


def top_words_per_key(df: DataFrame, key: str, text: str = "text", k: int = 5) -> DataFrame:
    """The ``k`` most frequent words per day (or another key), ties by word."""
    return top_n(word_counts(df, text, [key]), [key], [F.col("count").desc(), F.col("word").asc()], k)


def shelf(deliveries: DataFrame, as_of: str, cap: int = 5, hours: int = 24) -> DataFrame:
    """The last ``cap`` deliveries per user of the last ``hours``; ``place`` 1 is the oldest kept."""
    now = F.lit(as_of).cast("timestamp")
    recent = deliveries.filter(
        (F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOUR")) & (F.col("created_at") <= now)
    )
    kept = top_n(recent, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], cap, "newest")
    held = kept.groupBy("user_id").agg(F.count("*").alias("_held"))
    return kept.join(held, "user_id").withColumn("place", F.col("_held") - F.col("newest") + 1).drop("_held", "newest")


# W4 - W6 -----------------------------------------------------------------------------------

# Words before and after a pause that point to work at the board.
BOARD_BEFORE = [
    "لکھو", "لکھتے", "لکھیں", "لکھتی", "لکھتا", "بورڈ", "تختہ", "یہاں دیکھو", "یہاں", "نوٹ", "write", "board",
    "رائٹ", "نوٹ ڈاؤن",
]
BOARD_AFTER = [
    "دیکھو", "دیکھیں", "دیکھ", "یہ ہے", "یہ", "پڑھو", "پڑھیں", "سمجھ", "سمجھے", "look", "see", "read", "لوک", "سی",
]
WAIT_MS = 5_000
BOARD_MS = 15_000


def silences(
    tokens: DataFrame,
    key: str = "session_id",
    position: str = "pos",
    min_gap_ms: int = 3_000,
    before_words: Sequence[str] = tuple(BOARD_BEFORE),
    after_words: Sequence[str] = tuple(BOARD_AFTER),
    size: int = 10_000,
) -> DataFrame:
    """Pauses between tokens with the activity they suggest.

    ``tokens(key, pos, text, start_ms, end_ms)`` with dense positions from 1. The five tokens on
    either side are the context. Long transcripts are cut into blocks that overlap by those tokens.
    """
    blocks = with_neighbours(tokens, [key], position, 5, 4, size)
    order = Window.partitionBy(key, "_block").orderBy(position)
    seen = (
        blocks.withColumn("_prev_end", F.lag("end_ms").over(order))
        .withColumn("_b", F.collect_list("text").over(order.rowsBetween(-5, -1)))
        .withColumn("_a", F.collect_list("text").over(order.rowsBetween(0, 4)))
        .withColumn("duration_ms", F.col("start_ms") - F.col("_prev_end"))
        .filter(F.col("_home") & (F.col("duration_ms") >= min_gap_ms))
        .withColumn("context_before", F.trim(F.concat_ws("", "_b")))
        .withColumn("context_after", F.trim(F.concat_ws("", "_a")))
    )

    def says(text: str, words: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.col(text)), w))

    length = F.col("duration_ms")
    b, a = says("context_before", before_words), says("context_after", after_words)
    board = (length > WAIT_MS) & (length <= BOARD_MS)
    return seen.select(
        key,
        F.col(position).alias("next_pos"),
        F.col("_prev_end").alias("start_ms"),
        F.col("start_ms").alias("end_ms"),
        "duration_ms",
        F.when(length <= WAIT_MS, "wait_time")
        .when(board & (a | b), "board_writing")
        .when(board, "potential_board_writing")
        .otherwise("extended_activity")
        .alias("activity"),
        F.when(length <= WAIT_MS, "high")
        .when(board & a & b, "high")
        .when(a | b, "medium")
        .otherwise("low")
        .alias("confidence"),
        "context_before",
        "context_after",
    )


def self_corrections(readings: DataFrame) -> DataFrame:
    """A word outside the passage followed by one inside it. ``readings(id, words, passage)``
    holds both word lists of a reading in one row, so nothing moves."""
    pairs = F.transform(
        "words",
        lambda w, i: F.struct(
            w.alias("incorrect"), F.get("words", i + 1).alias("corrected"), i.alias("position")
        ),
    )
    known = F.map_from_entries(F.transform(F.array_distinct("passage"), lambda w: F.struct(w, F.lit(True))))
    with_map = readings.withColumn("_known", known)
    hits = F.filter(
        pairs,
        lambda p: ~F.map_contains_key("_known", p["incorrect"])
        & p["corrected"].isNotNull()
        & F.map_contains_key("_known", p["corrected"]),
    )
    return inline_into(with_map, ["id"], hits, "incorrect")


def precedes(lessons: DataFrame, book: str = "book_id", order: str = "segment_index", lesson: str = "lesson_id") -> DataFrame:
    """Each lesson linked to the next one of its book, as ``(book, src, dst)``."""
    lagged = carry_lag(lessons, [book], [order, lesson], [lesson], 10_000)
    return lagged.filter(F.col(f"prev_{lesson}").isNotNull()).select(
        book, F.col(f"prev_{lesson}").alias("src"), F.col(lesson).alias("dst")
    )


# W7 - W10 -----------------------------------------------------------------------------------


def assign_rolls(students: DataFrame, key: str = "list_id", position: str = "position", size: int = 10_000) -> DataFrame:
    """Students without a roll number continue from the list's highest one in input order."""
    top = students.groupBy(key).agg(F.greatest(F.coalesce(F.max("roll_number"), F.lit(0)), F.lit(0)).alias("_top"))
    missing = F.col("roll_number").isNull().cast("int")
    counted = running_total(students, [key], [position], missing, "_nth", position_chunk(position, size))
    return (
        counted.join(top, key)
        .withColumn("roll_number", F.coalesce("roll_number", (F.col("_top") + F.col("_nth")).cast("int")))
        .drop("_top", "_nth")
    )


def trailing_correct(answers: DataFrame, key: str = "session_id", position: str = "pos", n: int = 3, size: int = 10_000) -> DataFrame:
    """Correct answers among the last ``n``; NULL until ``n`` were given. Positions are dense."""
    blocks = with_neighbours(answers, [key], position, n - 1, 0, size)
    frame = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(-(n - 1), 0)
    return (
        blocks.withColumn("_sum", F.sum(F.col("is_correct").cast("int")).over(frame))
        .filter("_home")
        .withColumn("window_correct", F.when(F.col(position) >= n, F.col("_sum")))
        .drop("_block", "_home", "_sum")
    )


def prior_feedback(sessions: DataFrame, key: str = "user_id", size: int = 10_000, keep: int = 3) -> DataFrame:
    """Per completed session the number of earlier completed ones, their ids newest first while
    there are at most ``keep``, else a flag that they need a summary. ``created_at`` orders them."""
    done = sessions.filter(F.col("status") == "completed")
    placed = number_rows(done, [key], ["created_at", "id"], "_pos", F.date_trunc("month", F.col("created_at")))
    blocks = with_neighbours(placed, [key], "_pos", keep, 0, size)
    order = Window.partitionBy(key, "_block").orderBy("_pos")
    earlier = F.array_compact(F.array(*[F.lag("id", i).over(order) for i in range(1, keep + 1)]))
    prior = F.col("_pos") - 1
    return (
        blocks.withColumn("_earlier", earlier)
        .filter("_home")
        .select(
            key,
            "id",
            prior.alias("prior_count"),
            (prior > keep).alias("needs_summary"),
            F.when(prior <= keep, F.col("_earlier")).alias("verbatim_ids"),
        )
    )


def dense_index(questions: DataFrame, key: str = "quiz_id", order: str = "sort_order", tie: str = "question_id") -> DataFrame:
    """Number the given (attempted) questions 1..n per quiz by sort order."""
    return number_rows(questions, [key], [order, tie], "display_index", 10_000)
