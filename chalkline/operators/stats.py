"""Dashboard statistics.

Distinct counts are taken from one row per user (partial aggregation, one shuffle on
the user) instead of several ``count(distinct)`` over the raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.maths import half_up, rate, whole_pct
from chalkline.operators.filters import apply_scope, scope_columns, session_label
from chalkline.operators.joins import broadcast_scalars, interval_join


@dataclass(frozen=True)
class Tables:
    """The programme tables the dashboard reads."""

    users: DataFrame
    chat: DataFrame
    sessions: DataFrame
    lesson_plans: DataFrame
    coaching: DataFrame
    reading: DataFrame
    videos: DataFrame


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _ago(as_of: str, days: int) -> Column:
    return _at(as_of) - F.expr(f"INTERVAL {days} DAY")


def _features(t: Tables) -> DataFrame:
    """One row per use of a feature with the columns the counts need."""

    def rows(df: DataFrame, feature: str, done: Column, kind: Column, link: Column) -> DataFrame:
        return df.select(
            "user_id",
            "created_at",
            F.lit(feature).alias("feature"),
            done.alias("done"),
            kind.alias("kind"),
            link.alias("has_link"),
        )

    no, none = F.lit(False), F.lit(None).cast("string")
    return (
        rows(t.lesson_plans, "lesson_plans", no, F.col("type"), F.col("gamma_url").isNotNull())
        .unionByName(rows(t.coaching, "coaching", F.col("status") == "completed", none, no))
        .unionByName(rows(t.reading, "reading", F.col("status") == "completed", none, no))
        .unionByName(rows(t.videos, "videos", F.col("status") == "completed", none, no))
    )


# A1, A2, A7, A9, A10 --------------------------------------------------------------


def active_users(chat: DataFrame, as_of: str, days: int, exact: bool = True) -> DataFrame:
    """A2: users with a message of their own in the last ``days`` days."""
    recent = chat.filter((F.col("role") == "user") & (F.col("created_at") >= _ago(as_of, days)))
    counted = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id")
    return recent.agg(counted.alias("active_users"))


def session_averages(sessions: DataFrame) -> DataFrame:
    """Mean minutes of ended sessions and mean messages of all, one decimal."""
    minutes = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60_000_000
    return sessions.agg(
        F.coalesce(F.round(F.avg(minutes), 1), F.lit(0.0)).alias("avg_session_length"),
        F.coalesce(F.round(F.avg(F.coalesce("message_count", F.lit(0))), 1), F.lit(0.0)).alias("avg_messages"),
    )


def registration_rate(users: DataFrame) -> DataFrame:
    """Registered share of all users, one decimal."""
    return users.agg(F.count_if("registration_completed").alias("r"), F.count("*").alias("n")).select(
        rate(F.col("r"), F.col("n"), 1).alias("registration_rate")
    )


def _discovered(t: Tables, variant: str) -> tuple[DataFrame, int]:
    """Uses that count as discovery, and how many each user could have."""
    names = ["lesson_plans", "coaching", "reading", "videos"]
    if variant == "snapshot":
        names = names[:3]
    elif variant != "live":
        raise ValueError(f"unknown variant {variant!r}")
    per_user = (
        _features(t)
        .filter(F.col("feature").isin(names))
        .groupBy("user_id")
        .agg(*[F.max((F.col("feature") == n).cast("int")).alias(n) for n in names])
    )
    if variant == "snapshot":
        return per_user.agg(F.count("user_id").alias("_discovered")), 1
    flags = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    known = per_user.filter(F.col("user_id").isNotNull())
    return known.agg(F.coalesce(F.sum(flags), F.lit(0)).alias("_discovered")), 4


def feature_discovery(t: Tables, variant: str = "live") -> DataFrame:
    """A10: ``live`` = users per feature summed over four times the users; ``snapshot`` = users of
    plans, coaching or reading over the users."""
    used, per = _discovered(t, variant)
    return broadcast_scalars(used, t.users.agg(F.count("*").alias("n"))).select(
        rate(F.col("_discovered"), F.col("n") * per, 1).alias("feature_discovery_rate")
    )


def dashboard_stats(t: Tables, as_of: str, variant: str = "snapshot") -> DataFrame:
    """A1: the headline figures in one row. ``snapshot`` and ``live`` differ in the definition of
    plans, presentations, sessions, registration and discovery; both are kept."""
    if variant not in ("snapshot", "live"):
        raise ValueError(f"unknown variant {variant!r}")
    snapshot = variant == "snapshot"
    registered = F.col("registration_completed_at").isNotNull() if snapshot else F.col("registration_completed")
    users = t.users.agg(F.count("*").alias("total_users"), F.count_if(registered).alias("_registered"))
    said = F.col("role") == "user"
    per_user = t.chat.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(said & (F.col("message_type") == "voice")).alias("v"),
        F.max(F.when(said, F.col("created_at"))).alias("last"),
    )
    known = F.col("user_id").isNotNull()
    messages = per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("voice_notes_received"),
        F.count_if(known & (F.col("last") >= _ago(as_of, 1))).alias("daily_active_users"),
        F.count_if(known & (F.col("last") >= _ago(as_of, 7))).alias("weekly_active_users"),
    )
    sessions = t.sessions.filter(F.col("ended_at").isNotNull()) if snapshot else t.sessions
    today = F.date_trunc("day", _at(as_of))
    minutes = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60_000_000
    counts = sessions.agg(
        F.coalesce(F.round(F.avg(minutes), 1), F.lit(0.0)).alias("avg_session_length"),
        F.coalesce(F.round(F.avg(F.coalesce("message_count", F.lit(0))), 1), F.lit(0.0)).alias("avg_messages_per_session"),
        F.count("*").alias("total_sessions"),
        F.count_if(F.col("started_at") >= today).alias("sessions_today"),
        F.count_if(F.col("started_at") >= _ago(as_of, 7)).alias("sessions_this_week"),
    )
    is_plan = F.col("feature") == "lesson_plans"
    plans = is_plan if snapshot else is_plan & (F.col("kind") == "lesson_plan")
    slides = is_plan & (F.col("has_link") if snapshot else F.col("kind") == "presentation")
    done = [
        F.count_if(F.col("done") & (F.col("feature") == f)).alias(name)
        for f, name in (
            ("coaching", "total_coaching_sessions"),
            ("videos", "total_videos_generated"),
            ("reading", "total_reading_assessments"),
        )
    ]
    used = _features(t).agg(
        F.count_if(plans).alias("total_lesson_plans"), F.count_if(slides).alias("total_presentations"), *done
    )
    discovered, per = _discovered(t, variant)
    row = broadcast_scalars(users, messages, counts, used, discovered)
    total = F.col("total_users")
    return row.withColumns(
        {
            "registration_rate": rate(F.col("_registered"), total, 1),
            "feature_discovery_rate": rate(F.col("_discovered"), total * per, 1),
        }
    ).drop("_registered", "_discovered")


# A3 - A6, A12, A16 -------------------------------------------------------------------


def status_counts(requests: DataFrame) -> DataFrame:
    """A3: requests per status group and the rounded success rate."""
    status = F.col("status")
    counted = requests.agg(
        F.count("*").alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status.isin("processing", "queued")).alias("processing"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "cancelled").alias("cancelled"),
    )
    return counted.withColumn("success_rate", whole_pct(F.col("completed"), F.col("total")))


def coaching_status_counts(sessions: DataFrame) -> DataFrame:
    """A3: as above with everything unfinished as in progress."""
    status = F.col("status")
    return sessions.agg(
        F.count("*").alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "cancelled").alias("cancelled"),
        F.count_if(~status.isin("completed", "failed", "cancelled")).alias("in_progress"),
    )


def scope_stats(scopes: DataFrame) -> DataFrame:
    """A3: number of scopes per type."""
    kinds = ("all", "country", "school", "phone_list", "combined")
    return scopes.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("scope_type") == k).alias(f"scope_{k}") for k in kinds]
    )


def delivery_rates(messages: DataFrame, key: str = "broadcast_id") -> DataFrame:
    """A3: per broadcast sent, delivered (read counts too), read, replied and failed with rates on sent."""
    status = F.col("status")
    counted = messages.groupBy(key).agg(
        F.count_if(status != "pending").alias("sent"),
        F.count_if(status.isin("delivered", "read")).alias("delivered"),
        F.count_if(status == "read").alias("read"),
        F.count_if(F.col("replied_at").isNotNull()).alias("replied"),
        F.count_if(status == "failed").alias("failed"),
    )
    base = F.when(F.col("sent") == 0, 1).otherwise(F.col("sent"))
    names = {"delivered": "delivery_rate", "read": "read_rate", "replied": "reply_rate", "failed": "failure_rate"}
    return counted.withColumns({out: F.round(F.col(c) / base * 100, 1) for c, out in names.items()})


def daily_counts(df: DataFrame, as_of: str, days: int, ts: str = "created_at") -> DataFrame:
    """A4: rows per calendar day of the look-back."""
    return (
        df.filter(F.col(ts) >= _ago(as_of, days))
        .groupBy(F.to_date(ts).alias("date"))
        .agg(F.count("*").alias("count"))
    )


def daily_status_counts(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """A4: rows per day, in total, completed and failed."""
    return (
        df.filter(F.col("created_at") >= _ago(as_of, days))
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )


def hourly_histogram(sessions: DataFrame, ts: str = "started_at") -> DataFrame:
    """A5: 24 rows, zero for empty hours."""
    counts = sessions.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("count"))
    spine = sessions.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(counts, "hour", "left").fillna(0, ["count"])


def type_breakdown(sessions: DataFrame, coaching: DataFrame, videos: DataFrame) -> DataFrame:
    """Counts per kind of session; NULL and general count together, empty kinds are dropped."""
    known = ["lesson_plan", "presentation", "general", "audio_coaching"]
    code = F.coalesce("session_type", F.lit("general"))
    chat = sessions.select(code.alias("code")).filter(F.col("code").isin(known))
    other = coaching.select(F.lit("coaching").alias("code")).unionByName(
        videos.filter(F.col("status") == "completed").select(F.lit("ai_video_generation").alias("code"))
    )
    counts = chat.unionByName(other).groupBy("code").agg(F.count("*").alias("count"))
    return counts.select(session_label("code").alias("type"), "count").orderBy(F.col("count").desc(), "type")


def traffic_sources(users: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Users per source."""
    df = users.filter(F.col("source").isNotNull())
    if start:
        df = df.filter(F.col("created_at") >= _at(start))
    if end:
        df = df.filter(F.col("created_at") <= _at(end))
    return df.groupBy("source").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "source")


def users_with_counts(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Users with at least one request and their number of requests."""
    from chalkline.operators.filters import display_name

    counts = requests.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("count"))
    joined = users.join(counts, "id")
    return joined.select(
        "id", display_name().alias("name"), F.col("phone_number").alias("phone"), "count"
    ).orderBy(F.col("count").desc(), "id")


# A8 ------------------------------------------------------------------------------------


def period_compare(t: Tables, start: str, end: str, prev_start: str, prev_end: str) -> DataFrame:
    """14 metrics of a period beside the period before, as rows (metric, current, previous,
    change). Both ends are inclusive. Counts change in percent (0 before: 100 or 0), rates in
    points. Every table is read once for both periods."""
    spans = {"cur": (_at(start), _at(end)), "prev": (_at(prev_start), _at(prev_end))}

    def inside(ts: str, which: str) -> Column:
        lo, hi = spans[which]
        return F.col(ts).between(lo, hi)

    def near(df: DataFrame, ts: str) -> DataFrame:
        return df.filter(F.col(ts).between(_at(prev_start), _at(end)))

    def each(ts: str, **conds: Column) -> list[Column]:
        return [
            F.count_if(inside(ts, w) & cond).alias(f"{w}_{name}") for name, cond in conds.items() for w in spans
        ]

    yes = F.lit(True)
    flags = (
        _features(t)
        .groupBy("user_id")
        .agg(
            sum(
                (F.max((F.col("feature") == f).cast("int")) for f in ("coaching", "reading", "videos")),
                F.max((F.col("feature") == "lesson_plans").cast("int")),
            ).alias("tried")
        )
        .withColumnRenamed("user_id", "id")
    )
    newcomers = near(t.users, "created_at").join(flags, "id", "left")
    users = newcomers.agg(
        *each("created_at", total_users=yes, registered=F.coalesce("registration_completed", F.lit(False))),
        *[
            F.coalesce(F.sum(F.when(inside("created_at", w), F.coalesce("tried", F.lit(0)))), F.lit(0)).alias(f"{w}_tried")
            for w in spans
        ],
    )
    said = F.col("role") == "user"
    per_user = (
        near(t.chat, "created_at")
        .groupBy("user_id")
        .agg(
            *each("created_at", n=yes, v=said & (F.col("message_type") == "voice"), u=said),
        )
    )
    messages = per_user.agg(
        *[F.coalesce(F.sum(f"{w}_n"), F.lit(0)).alias(f"{w}_total_messages") for w in spans],
        *[F.coalesce(F.sum(f"{w}_v"), F.lit(0)).alias(f"{w}_voice_notes_received") for w in spans],
        *[F.count_if(F.col(f"{w}_u") > 0).alias(f"{w}_active_users") for w in spans],
    )
    minutes = (F.unix_micros("last_activity_at") - F.unix_micros("started_at")) / 60_000_000
    sessions = near(t.sessions, "started_at").agg(
        *each("started_at", total_sessions=yes),
        *[
            F.coalesce(half_up(F.avg(F.when(inside("started_at", w), minutes))), F.lit(0)).alias(f"{w}_avg_session_length")
            for w in spans
        ],
    )
    f, kind, done = F.col("feature"), F.col("kind"), F.col("done")
    used = near(_features(t), "created_at").agg(
        *each(
            "created_at",
            total_lesson_plans=(f == "lesson_plans") & (kind == "lesson_plan"),
            total_presentations=(f == "lesson_plans") & (kind == "presentation"),
            total_coaching_sessions=(f == "coaching") & done,
            total_videos_generated=(f == "videos") & done,
            total_reading_assessments=(f == "reading") & done,
        )
    )
    row = broadcast_scalars(users, messages, sessions, used)
    for w in spans:
        total = F.col(f"{w}_total_users")
        row = row.withColumns(
            {
                f"{w}_registration_rate": whole_pct(F.col(f"{w}_registered"), total),
                f"{w}_feature_discovery_rate": whole_pct(F.col(f"{w}_tried"), total * 4),
                f"{w}_sessions_today": F.col(f"{w}_total_sessions"),
            }
        )
    counts = [
        "total_users", "total_messages", "voice_notes_received", "total_sessions", "sessions_today",
        "avg_session_length", "total_lesson_plans", "total_presentations", "total_coaching_sessions",
        "total_videos_generated", "total_reading_assessments", "active_users",
    ]
    points = ["registration_rate", "feature_discovery_rate"]
    cells = []
    for name in counts + points:
        cur, prev = F.col(f"cur_{name}").cast("bigint"), F.col(f"prev_{name}").cast("bigint")
        if name in points:
            change = (cur - prev).cast("bigint")
        else:
            change = (
                F.when(prev == 0, F.when(cur > 0, 100).otherwise(0)).otherwise(half_up((cur - prev) / prev * 100))
            ).cast("bigint")
        cells.append(
            F.struct(F.lit(name).alias("metric"), cur.alias("current"), prev.alias("previous"), change.alias("change"))
        )
    return row.select(F.inline(F.array(*cells)))


def previous_period(start: str, end: str) -> tuple[str, str, str, str]:
    """Whole-day bounds of a period and of the equally long period that ends just before it."""
    import datetime as dt

    lo, hi = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    days = (hi - lo).days + 1
    before = lo - dt.timedelta(days=days + 1)
    return (
        f"{lo} 00:00:00",
        f"{hi} 23:59:59.999",
        f"{before} 00:00:00",
        f"{lo - dt.timedelta(days=1)} 23:59:59.999",
    )


# A11 --------------------------------------------------------------------------------------


def funnel(visits: DataFrame, clicks: DataFrame, starts: DataFrame, users: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Four stage counts, step rates and drop-offs."""

    def stage(df: DataFrame, ts: str, name: str) -> DataFrame:
        if start:
            df = df.filter(F.col(ts) >= _at(start))
        if end:
            df = df.filter(F.col(ts) <= _at(end))
        return df.agg(F.count("*").alias(name))

    registered = users.filter(F.col("registration_completed"))
    row = broadcast_scalars(
        stage(visits, "created_at", "website_visits"),
        stage(clicks, "created_at", "cta_clicks"),
        stage(starts, "created_at", "chat_starts"),
        stage(registered, "registration_completed_at", "registrations"),
    )
    steps = ["website_visits", "cta_clicks", "chat_starts", "registrations"]
    v, c, s, r = (F.col(x) for x in steps)
    return row.withColumns(
        {
            "visit_to_cta": rate(c, v, 2),
            "cta_to_chat": rate(s, c, 2),
            "chat_to_registration": rate(r, s, 2),
            "overall": rate(r, v, 2),
            "lost_after_visit": v - c,
            "lost_after_cta": c - s,
            "lost_after_chat": s - r,
        }
    )


# A13, A14 -----------------------------------------------------------------------------------

# Retention buckets as half-open day offsets, and the age in days at which a
# cohort's bucket is complete.
BUCKETS = [
    ("week1", 1, 8),
    ("week2", 8, 15),
    ("week3", 15, 22),
    ("week4", 22, 29),
    ("week5_8", 29, 57),
    ("week9_12", 57, 85),
]
MATURE_AFTER = {"week2": 14, "week3": 21, "week4": 28, "week5_8": 56, "week9_12": 84}

FEATURES = {
    "overall": ("coaching", "lesson_plans", "reading", "chat"),
    "coaching": ("coaching",),
    "lesson_plans": ("lesson_plans",),
    "reading": ("reading",),
}


def retention_activity(feature: str, **tables: DataFrame) -> DataFrame:
    """The activity that counts for a feature, as (user_id, at). ``coaching`` and ``reading``
    count when completed; chat counts for ``overall`` only."""
    if feature not in FEATURES:
        raise ValueError(f"unknown feature {feature!r}")
    out = None
    for name in FEATURES[feature]:
        df = tables[name]
        if name in ("coaching", "reading"):
            df = df.filter(F.col("status") == "completed")
        part = df.select("user_id", F.col("created_at").alias("at"))
        out = part if out is None else out.unionByName(part)
    return out


def retention_cohorts(
    users: DataFrame,
    activity: DataFrame,
    as_of: str,
    start: str | None = None,
    end: str | None = None,
    buckets: list[tuple[str, int, int]] = BUCKETS,
) -> DataFrame:
    """Weekly cohorts of ``users(id, created_at)`` with activity per bucket.

    Day 0 is the calendar date of the start, week 1 begins 24 hours after it, and ``end`` is
    midnight at its start, as in the source definitions."""
    people = users.filter(F.col("created_at").isNotNull())
    if start:
        people = people.filter(F.col("created_at") >= F.lit(start).cast("date").cast("timestamp"))
    if end:
        people = people.filter(F.col("created_at") <= F.lit(end).cast("date").cast("timestamp"))
    starts = people.select(
        F.col("id").alias("user_id"),
        F.col("created_at").alias("started_at"),
        F.to_date(F.date_trunc("week", "created_at")).alias("cohort_week"),
    )
    seen = interval_join(starts, activity, buckets)
    size = F.count("*")
    aggs = [
        size.alias("cohort_size"),
        F.round(F.lit(100.0) * F.count_if("day0") / size, 1).alias("day0_activation_pct"),
    ]
    for name, _, _ in buckets:
        aggs.append(F.count_if(name).alias(f"{name}_users"))
        aggs.append(F.round(F.lit(100.0) * F.count_if(name) / size, 1).alias(f"{name}_pct"))
    cohorts = seen.groupBy("cohort_week").agg(*aggs)
    today = F.lit(as_of).cast("date")
    names = {b[0] for b in buckets}
    return cohorts.withColumns(
        {
            f"has_{name}_data": today >= F.date_add("cohort_week", days)
            for name, days in MATURE_AFTER.items()
            if name in names
        }
    )


def retention_snapshot(users: DataFrame, activity: DataFrame, as_of: str) -> DataFrame:
    """A13, snapshot form: users of the last 12 weeks, activity of the last 16, weeks 1 to 4."""
    recent = users.filter(F.col("created_at") >= _at(as_of) - F.expr("INTERVAL 84 DAY"))
    near = activity.filter(F.col("at") >= _at(as_of) - F.expr("INTERVAL 112 DAY"))
    return retention_cohorts(recent, near, as_of, buckets=BUCKETS[:4]).withColumn("feature_type", F.lit("overall"))


def _tenth(x: Column) -> Column:
    return half_up(x * 10) / 10


def retention_summary(cohorts: DataFrame) -> DataFrame:
    """Means over cohorts, newest cohort, and the trend of the newest four against the four
    before. ``cohorts`` has one row per week, so ranking them in one task is small."""
    ranked = cohorts.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("cohort_week").desc())))

    def trend(column: str) -> Column:
        newest = F.avg(F.when(F.col("_rank") <= 4, F.col(column)))
        before = F.avg(F.when(F.col("_rank").between(5, 8), F.col(column)))
        return _tenth(F.coalesce(newest, F.lit(0.0)) - F.coalesce(before, F.lit(0.0)))

    def mean(column: str, flag: str | None = None) -> Column:
        value = F.avg(F.when(F.col(flag), F.col(column)) if flag else F.col(column))
        return F.coalesce(_tenth(value), F.lit(0.0))

    return ranked.agg(
        F.coalesce(half_up(F.avg("cohort_size")), F.lit(0)).cast("bigint").alias("avg_cohort_size"),
        mean("week1_pct", "has_week2_data").alias("avg_week1_retention"),
        mean("week4_pct", "has_week4_data").alias("avg_week4_retention"),
        mean("day0_activation_pct").alias("avg_day0_activation"),
        F.coalesce(F.sum("cohort_size"), F.lit(0)).alias("total_users"),
        F.count("*").alias("active_cohorts"),
        trend("week1_pct").alias("week1_trend"),
        trend("day0_activation_pct").alias("activation_trend"),
        F.max_by("cohort_size", "cohort_week").alias("latest_cohort_size"),
        F.max("cohort_week").alias("latest_cohort_week"),
    )


def retention_curve(cohorts: DataFrame, newest: int = 3, weeks: list[str] | None = None) -> DataFrame:
    """Long rows (series, point, label, pct): chosen cohorts, NULL before maturity, plus the
    average line over all cohorts when there is more than one."""
    points = [("Day 0", None, None), ("Week 1", "week1", None)] + [
        (label, name, f"has_{name}_data")
        for label, name in (
            ("Week 2", "week2"),
            ("Week 3", "week3"),
            ("Week 4", "week4"),
            ("Week 5-8", "week5_8"),
            ("Week 9-12", "week9_12"),
        )
    ]

    def value(name: str | None, flag: str | None) -> Column:
        if name is None:
            return F.lit(100.0)
        pct = F.col(f"{name}_pct")
        return F.when(F.col(flag), pct) if flag else pct

    def unpivot(df: DataFrame) -> DataFrame:
        cells = [
            F.struct(F.lit(i).alias("point"), F.lit(label).alias("label"), F.col(f"_p{i}").alias("pct"))
            for i, (label, _, _) in enumerate(points)
        ]
        return df.select("series", F.inline(F.array(*cells)))

    if weeks:
        chosen = cohorts.filter(F.col("cohort_week").isin([F.lit(w).cast("date") for w in weeks]))
    else:
        chosen = cohorts.orderBy(F.col("cohort_week").desc()).limit(newest)
    lines = chosen.select(
        F.col("cohort_week").cast("string").alias("series"),
        *[value(name, flag).alias(f"_p{i}") for i, (_, name, flag) in enumerate(points)],
    )
    mean = (
        cohorts.agg(
            F.count("*").alias("_n"),
            *[
                (F.max(F.lit(100.0)) if name is None else _tenth(F.avg(value(name, flag)))).alias(f"_p{i}")
                for i, (_, name, flag) in enumerate(points)
            ],
        )
        .filter(F.col("_n") > 1)
        .withColumn("series", F.lit("Average"))
        .drop("_n")
    )
    return unpivot(lines).unionByName(unpivot(mean))


def compare_cohorts(cohorts: DataFrame, first: str, second: str) -> DataFrame:
    """Differences in points between two cohort weeks, NULL while one of them is too young."""
    a = cohorts.filter(F.col("cohort_week") == F.lit(first).cast("date"))
    b = cohorts.filter(F.col("cohort_week") == F.lit(second).cast("date"))
    other = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    pair = a.select([F.col(c).alias(f"a_{c}") for c in a.columns]).crossJoin(F.broadcast(other))  # one week each

    def diff(column: str, flag: str | None = None) -> Column:
        out = _tenth(F.col(f"b_{column}") - F.col(f"a_{column}"))
        return F.when(F.col(f"a_{flag}") & F.col(f"b_{flag}"), out) if flag else out

    return pair.select(
        F.col("a_cohort_week").alias("first_week"),
        F.col("b_cohort_week").alias("second_week"),
        (F.col("b_cohort_size") - F.col("a_cohort_size")).alias("size_change"),
        diff("day0_activation_pct").alias("day0_change"),
        diff("week1_pct").alias("week1_change"),
        diff("week2_pct", "has_week2_data").alias("week2_change"),
        diff("week3_pct", "has_week3_data").alias("week3_change"),
        diff("week4_pct", "has_week4_data").alias("week4_change"),
    )


def heat_band(pct: Column) -> Column:
    """Colour band of a retention percentage."""
    return (
        F.when(pct.isNull(), "na")
        .when(pct >= 50, "excellent")
        .when(pct >= 40, "good")
        .when(pct >= 30, "moderate")
        .when(pct >= 20, "fair")
        .when(pct >= 10, "poor")
        .otherwise("critical")
    )


# A15 -------------------------------------------------------------------------------------------


def country_rollup(t: Tables, plan_requests: DataFrame, as_of: str) -> DataFrame:
    """Figures per two-digit country, test users left out. Facts are counted per user first."""
    people = scope_columns(t.users).filter(~F.col("is_test_user"))
    chat = t.chat.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("created_at") >= _ago(as_of, 1)).alias("today"),
        F.max("created_at").alias("last"),
    )
    facts = {
        "total_lesson_plans": plan_requests,
        "total_coaching_sessions": t.coaching,
        "total_reading_assessments": t.reading,
        "total_video_requests": t.videos,
    }
    long = None
    for name, df in facts.items():
        part = df.select(F.col("user_id").alias("id"), F.lit(name).alias("fact"))
        long = part if long is None else long.unionByName(part)
    used = long.groupBy("id").agg(*[F.count_if(F.col("fact") == n).alias(n) for n in facts])
    zero = F.lit(0)
    return (
        people.join(chat, "id", "left")
        .join(used, "id", "left")
        .groupBy("country_code")
        .agg(
            F.count("*").alias("total_users"),
            F.count_if("registration_completed").alias("registered_users"),
            F.count_if(F.col("created_at") >= _ago(as_of, 1)).alias("new_users_today"),
            F.count_if(F.col("created_at") >= _ago(as_of, 7)).alias("new_users_week"),
            F.coalesce(F.sum("n"), zero).alias("total_messages"),
            F.coalesce(F.sum("today"), zero).alias("messages_today"),
            F.count_if(F.col("last") >= _ago(as_of, 1)).alias("daily_active_users"),
            F.count_if(F.col("last") >= _ago(as_of, 7)).alias("weekly_active_users"),
            *[F.coalesce(F.sum(n), zero).alias(n) for n in facts],
        )
    )


def scoped_stats(rollup: DataFrame, activity: DataFrame, scope: Mapping, as_of: str) -> DataFrame:
    """Figures for a scope. A country scope adds up the small rollup; any other scope
    aggregates the user snapshot (J1 columns plus scope columns)."""
    if not isinstance(scope, Mapping) or not scope.get("type"):
        raise ValueError("a scope with a type is required")
    codes = (scope.get("value") or {}).get("country_codes")
    zero = F.lit(0)
    if scope["type"] == "country" and codes:
        wanted = [str(c).removeprefix("+").strip() for c in codes]
        names = ["total_users", "registered_users", "total_messages", "daily_active_users", "weekly_active_users"]
        return rollup.filter(F.col("country_code").isin(wanted)).agg(
            *[F.coalesce(F.sum(n), zero).alias(n) for n in names]
        )
    return apply_scope(activity, scope).agg(
        F.count("*").alias("total_users"),
        F.count_if("registration_completed").alias("registered_users"),
        F.coalesce(F.sum("total_messages"), zero).alias("total_messages"),
        F.count_if(F.col("last_activity") >= _ago(as_of, 1)).alias("daily_active_users"),
        F.count_if(F.col("last_activity") >= _ago(as_of, 7)).alias("weekly_active_users"),
    )


# A38, A43 ----------------------------------------------------------------------------------------


def programme_counts(users: DataFrame, chat: DataFrame, lesson_plans: DataFrame, as_of: str) -> DataFrame:
    """Registered teachers, active in 7 days, plans in 30 days."""
    teachers = users.filter(F.col("registration_completed") & ~F.coalesce("is_test_user", F.lit(False)))
    return broadcast_scalars(
        teachers.agg(F.count("*").alias("teachers")),
        active_users(chat, as_of, 7).withColumnRenamed("active_users", "active_teachers_7d"),
        lesson_plans.filter(F.col("created_at") >= _ago(as_of, 30)).agg(F.count("*").alias("lesson_plans_30d")),
    )


def session_counters(messages: DataFrame) -> DataFrame:
    """Messages and completed turns (assistant rows) per session."""
    return (
        messages.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("turn_count"))
    )


def student_counts(students: DataFrame) -> DataFrame:
    """Active students per list."""
    return students.groupBy("list_id").agg(F.count_if("is_active").alias("student_count"))
