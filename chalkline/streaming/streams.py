"""ST: the live versions. Each function maps a streaming DataFrame to a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chalkline.sources.parts import pointer, read_parts, replace_parts
from chalkline.sources.sinks import refresh_all, refresh_days
from chalkline.sources.tables import declared

MINUTE = 60_000_000
HOUR = 60 * MINUTE  # microseconds, as timestamps are kept


def read_stream(spark: SparkSession, name: str, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a declared table as a stream; zone-less times are read as UTC."""
    reader = spark.readStream.schema(declared(name)).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """ST1: sessions of each user, closed after more than ``gap`` of silence; the end is the last event."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.col(user).alias("user_id"), F.session_window(ts, gap))
        .agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("message_count"))
        .drop("session_window")
    )


def stream_counters(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """ST2: messages and completed turns per session, of a batch or (update mode) of a stream."""
    return messages.groupBy(key).agg(
        F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("turn_count")
    )


def stream_delivery_counters(updates: DataFrame, key: str = "broadcast_id") -> DataFrame:
    """ST2: delivery counters of each broadcast, of a batch or (update mode) of a stream."""
    status = F.col("status")
    return updates.groupBy(key).agg(
        F.count_if(status == "sent").alias("sent_count"),
        F.count_if(status.isin("delivered", "read")).alias("delivered_count"),
        F.count_if(status == "read").alias("read_count"),
        F.count_if(status == "failed").alias("failed_count"),
        F.count("replied_at").alias("replied_count"),
    )


def _added(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in partials.columns if c not in keys]
    return partials.groupBy(*keys).agg(*sums)


def merge_counts(counts: DataFrame, batch_id: int, folder: str, keys: Sequence[str], fold_after: int = 16) -> bool:
    """ST2: add the counts of one micro-batch to a stored table, once; whether they were new.

    ``counts`` holds one row a key; its other columns are added up. Each batch is a part of its own, so a
    trigger writes what it got and reads nothing; after ``fold_after`` batches all parts become one, with
    one row a key. The commit carries the batch id, so a batch that is replayed after a crash is known and
    left out, and one that died before its commit is written again.
    """
    spark = counts.sparkSession
    now = pointer(spark, folder)
    if now is not None and now["tag"] >= batch_id:
        return False
    if now is not None and len(now["parts"]) >= fold_after:
        # by name: a stored table and a batch may differ in the order of their columns
        counts = _added(read_parts(spark, folder).unionByName(counts), keys)
        replace_parts(counts, folder, F.lit("all"), gone=None, tag=batch_id)
    else:
        replace_parts(counts, folder, F.lit(batch_id), tag=batch_id)
    return True


def read_counts(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """ST2: the counters as of the newest batch: what the parts of ``merge_counts`` add up to."""
    return _added(read_parts(spark, folder), keys)


def stream_merge(
    rows: DataFrame,
    counts: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    folder: str,
    checkpoint: str,
    every: str | None = "1 minute",
    fold_after: int = 16,
):
    """ST2: keep ``counts`` (``stream_counters``, ``stream_delivery_counters``) of a stream in a table.

    Each trigger (``every``, or what is there when None) groups its own rows only and merges them by batch
    id, so the stream holds no state, whatever the number of keys.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_counts(counts(batch), batch_id, folder, keys, fold_after)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_visits(visits: DataFrame, key: str = "session_id", ts: str = "created_at", delay: str = "1 day") -> DataFrame:
    """ST3: first visit seen per session id; keys are forgotten ``delay`` after their last sighting."""
    return visits.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# ST4, ST5 ------------------------------------------------------------------------------


# A step runs once a key and trigger, so it takes what it needs as plain arrays and makes no frame without rows.


def _micros(column: pd.Series) -> np.ndarray:
    return column.to_numpy().astype("datetime64[us]").astype(np.int64)


def _frames(out: list[tuple], names: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of a step as a frame; none for no rows."""
    if out:
        yield pd.DataFrame(out, columns=list(names), dtype=object)


def _timer(due: int, now: int) -> int:
    """Milliseconds at which the watermark has passed ``due``, after the present one."""
    return max(-(-due // 1000), now // 1000 + 1)


def stream_stale(
    activity: DataFrame,
    ts: str = "ts",
    delay: str = "1 hour",
    remind_after: int = 2 * HOUR,
    complete_after: int = 12 * HOUR,
    busy_for: int = 5 * MINUTE,
) -> DataFrame:
    """ST4: ``activity(session_id, ts, kind)`` with kind ``session`` for interactions of an open
    session and ``chat`` for anything else its user does. One reminder after two idle hours, completion
    after twelve; both wait until the user has been quiet for five minutes. State per session is three
    numbers and the order of rows does not matter.

    State leaves at completion, and for keys without an open session once the watermark is ``busy_for`` past their
    last chat: a session row that still counts is later than that, so the chat can delay nothing any more."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, chat, reminded = state.get if state.exists else (0, 0, False)
        now = state.getCurrentWatermarkMs() * 1000
        out = []
        if state.hasTimedOut:
            quiet = chat + busy_for
            if last and now >= max(last + complete_after, quiet):
                out.append((key[0], "auto_complete", max(last + complete_after, quiet)))
            elif last and not reminded and now >= max(last + remind_after, quiet):
                out.append((key[0], "reminder", max(last + remind_after, quiet)))
                reminded = True
        else:
            for pdf in batches:
                us = _micros(pdf["ts"])
                mine = (pdf["kind"] == "session").to_numpy()
                if mine.any():
                    last = max(last, int(us[mine].max()))
                if (~mine).any():
                    chat = max(chat, int(us[~mine].max()))
        if state.hasTimedOut and (not last or out and out[0][1] == "auto_complete"):
            state.remove()
        else:
            state.update((last, chat, reminded))
            idle = complete_after if reminded else remind_after
            state.setTimeoutTimestamp(_timer(max(last + idle, chat + busy_for), now))
        yield from _frames(out, ["session_id", "action", "due_us"])

    rows = activity.select(F.col("session_id").cast("string").alias("session_id"), F.col(ts).alias("ts"), "kind")
    acted = rows.withWatermark("ts", delay).groupBy("session_id").applyInPandasWithState(
        step,
        "session_id string, action string, due_us bigint",
        "last bigint, chat bigint, reminded boolean",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return acted.select("session_id", "action", F.timestamp_micros("due_us").alias("due_at"))


def stream_expiry(
    answers: DataFrame,
    ts: str = "ts",
    delay: str = "1 hour",
    remind_after: int = 30 * MINUTE,
    expire_after: int = 24 * HOUR,
    forget_after: int = 7 * 24 * HOUR,
) -> DataFrame:
    """ST5: ``answers(session_id, ts, is_correct)``: one reminder after 30 idle minutes, expiry 24
    hours after the start with the rounded share of correct answers.

    An expired session keeps its state, without a second reminder or expiry, until ``forget_after`` past its last
    answer and its expiry; answers that come meanwhile change nothing. An id that is used again after that
    is a new session, so the state is bounded by the sessions of that time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, answered, correct, reminded, expired = state.get if state.exists else (0, 0, 0, 0, False, False)
        now = state.getCurrentWatermarkMs() * 1000
        out = []
        forget = False
        if state.hasTimedOut and expired:
            forget = now >= max(last, start + expire_after) + forget_after
        elif state.hasTimedOut:
            if not reminded and last + remind_after < start + expire_after and now >= last + remind_after:
                out.append((key[0], "reminder", last + remind_after, None))
            reminded = reminded or now >= last + remind_after
            if now >= start + expire_after:
                share = int((100 * correct / answered) + 0.5) if answered else 0
                out.append((key[0], "expired", start + expire_after, share))
                expired = True
        else:
            for pdf in batches:
                us = _micros(pdf["ts"])
                if expired:
                    last = max(last, int(us.max()))
                    continue
                first = int(us.min())
                start = first if not start else min(start, first)
                last = max(last, int(us.max()))
                marks = pdf["is_correct"].to_numpy()
                marks = marks[pd.notna(marks)].astype(bool)
                answered += len(marks)
                correct += int(marks.sum())
        if forget:
            state.remove()
        else:
            state.update((start, last, answered, correct, reminded, expired))
            if expired:
                due = max(last, start + expire_after) + forget_after
            else:
                due = start + expire_after if reminded else min(last + remind_after, start + expire_after)
            state.setTimeoutTimestamp(_timer(due, now))
        yield from _frames(out, ["session_id", "action", "due_us", "mastery"])

    rows = answers.select(F.col("session_id").cast("string").alias("session_id"), F.col(ts).alias("ts"), "is_correct")
    acted = rows.withWatermark("ts", delay).groupBy("session_id").applyInPandasWithState(
        step,
        "session_id string, action string, due_us bigint, mastery bigint",
        "start bigint, last bigint, answered bigint, correct bigint, reminded boolean, expired boolean",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return acted.select("session_id", "action", F.timestamp_micros("due_us").alias("due_at"), "mastery")


# ST6 - ST8 --------------------------------------------------------------------------------


def stream_nudge(plans: DataFrame, coaching: DataFrame, within: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """ST6: plans without a coaching session of the same user in the two hours after them."""
    p = plans.select(F.col("id").alias("plan_id"), "user_id", F.col("created_at").alias("plan_at")).withWatermark("plan_at", delay)
    c = coaching.select(F.col("user_id").alias("coached_user"), F.col("created_at").alias("coached_at")).withWatermark(
        "coached_at", delay
    )
    joined = p.join(
        c,
        (F.col("user_id") == F.col("coached_user"))
        & (F.col("coached_at") >= F.col("plan_at"))
        & (F.col("coached_at") <= F.col("plan_at") + F.expr(f"INTERVAL {within}")),
        "leftOuter",
    )
    return joined.filter(F.col("coached_at").isNull()).select("plan_id", "user_id", "plan_at")


def stream_snapshot(
    changes: DataFrame,
    views: Mapping[str, Callable[[], DataFrame]],
    folder: str,
    checkpoint: str,
    now: Callable[[], str],
    report: Callable[[list[dict]], None],
    every: str | None = "5 minutes",
):
    """ST7: refresh all snapshots every ``every`` while rows arrive (once when None). ``report`` gets
    the timings and errors of each round."""

    def refresh(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            report(refresh_all(views, folder, now()))

    writer = changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_daily(
    changes: DataFrame,
    views: Mapping[str, tuple[str, Callable[[Sequence[str]], DataFrame]]],
    folder: str,
    checkpoint: str,
    now: Callable[[], str],
    every: str | None = "5 minutes",
    ts: str = "ts",
):
    """ST7: refresh only the days that new rows fall on, every ``every`` while rows arrive (once when None).

    ``views`` names for each view its date column and a function that computes daily sums of the days it is
    given (``refresh_days``). A trigger lists the days of its rows, at most one short text a day of the data,
    and each view replaces these days together; a batch that is replayed replaces them by the same. What a
    reader adds up is a table of one part a day. Rows without a time change no day.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(ts).cast("string").alias("day")
        days = sorted(r["day"] for r in batch.filter(F.col(ts).isNotNull()).select(day).distinct().collect())
        for name, (column, daily) in views.items() if days else ():
            refresh_days(folder, name, daily, column, days, now())

    writer = changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_rate(events: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """ST8: events per calendar day."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"))
        .agg(F.count("*").alias("count"))
        .select(F.to_date("window.start").alias("date"), "count")
    )


def stream_trailing(events: DataFrame, ts: str, days: int = 7, delay: str = "1 day") -> DataFrame:
    """ST8: events in the ``days`` days that end with each day."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{days} days", "1 day"))
        .agg(F.count("*").alias("count"))
        .select(F.date_sub(F.to_date("window.end"), 1).alias("last_day"), "count")
    )
