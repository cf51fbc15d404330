"""P: projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.ordered import top_n

# Routes that are never logged, and how static files are recognised.
EXCLUDED_ROUTES = ["/health", "/favicon.ico"]
STATIC_SUFFIXES = [".css", ".js", ".png", ".jpg", ".svg", ".ico", ".woff", ".woff2"]
STATIC_FOLDERS = ["/assets/", "/css/", "/js/", "/images/"]

# Labels of session types.
SESSION_LABELS = {
    "lesson_plan": "Lesson Plan",
    "presentation": "Presentation",
    "general": "General Chat",
    "audio_coaching": "Audio Coaching",
    "coaching": "Coaching Session",
    "ai_video_generation": "AI Video Generation",
    "reading_assessment": "Reading Assessment",
}


# P1 -------------------------------------------------------------------------


def filter_requests(
    requests: DataFrame,
    users: DataFrame,
    status: str = "all",
    language: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    user_id=None,
    topic: str | None = None,
) -> DataFrame:
    """AND of the given predicates over requests of known users."""
    df = requests
    if status == "processing":
        df = df.filter(F.col("status").isin("processing", "queued"))
    elif status != "all":
        df = df.filter(F.col("status") == status)
    if language:
        df = df.filter(F.col("language") == language)
    if date_from:
        df = df.filter(F.col("created_at") >= F.lit(f"{date_from} 00:00:00").cast("timestamp"))
    if date_to:
        df = df.filter(F.col("created_at") <= F.lit(f"{date_to} 23:59:59").cast("timestamp"))
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if topic:
        df = df.filter(F.col("topic").ilike(f"%{topic}%"))
    people = users.select(F.col("id").alias("user_id"), "first_name", "last_name", "phone_number", "school_name")
    return df.join(people, "user_id")


def page_of(df: DataFrame, page: int, limit: int, newest: str = "created_at") -> DataFrame:
    """One page, newest first."""
    offset = (max(1, page) - 1) * limit
    return df.orderBy(F.col(newest).desc(), F.col("id").asc()).offset(offset).limit(limit)


def page_totals(df: DataFrame, page: int, limit: int) -> DataFrame:
    """Total rows and whether a later page exists."""
    offset = (max(1, page) - 1) * limit
    return df.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > offset + limit)


# P2 / P3 ---------------------------------------------------------------------


def _values(scope: Mapping, field: str) -> list[str]:
    given = (scope.get("value") or {}).get(field) or []
    if isinstance(given, str):
        raise ValueError(f"{field} must be a list")
    return [str(v) for v in given]


def _code(text: str) -> str:
    return text.removeprefix("+").strip()


def scope_columns(users: DataFrame) -> DataFrame:
    """Country code, lower-cased school and a two-valued test flag for scope filters."""
    return users.withColumns(
        {
            "country_code": F.left("phone_number", F.lit(2)),
            "school_name_lower": F.lower(F.coalesce("school_name", F.lit(""))),
            "is_test_user": F.coalesce("is_test_user", F.lit(False)),
        }
    )


def apply_scope(df: DataFrame, scope: Mapping) -> DataFrame:
    """Rows a partner may see. An empty or unknown scope raises and never widens."""
    if not isinstance(scope, Mapping) or not scope.get("type"):
        raise ValueError("a scope with a type is required")
    kind = scope["type"]
    parts = {
        "country": ("country_codes", lambda v: F.col("country_code").isin([_code(x) for x in v])),
        "school": ("school_names", lambda v: F.col("school_name_lower").isin([x.lower().strip() for x in v])),
        "phone_list": ("phone_numbers", lambda v: F.col("phone_number").isin(v)),
    }
    visible = df.filter(~F.col("is_test_user"))
    if kind == "all":
        return visible
    if kind in parts:
        field, predicate = parts[kind]
        given = _values(scope, field)
        if not given:
            raise ValueError(f"scope {kind} needs {field}")
        return visible.filter(predicate(given))
    if kind == "combined":
        chosen = [predicate(_values(scope, field)) for field, predicate in parts.values() if _values(scope, field)]
        if not chosen:
            raise ValueError("a combined scope needs at least one list")
        allowed = chosen[0]
        for predicate in chosen[1:]:
            allowed = allowed | predicate
        return visible.filter(allowed)
    raise ValueError(f"unknown scope type {kind!r}")


def preview_filter(users: DataFrame, scope: Mapping) -> DataFrame:
    """The preview's own rule: country is a phone prefix, combined is AND, test users stay."""
    kind = scope.get("type")

    def prefixes(codes: Sequence[str]) -> Column:
        hit = F.lit(False)
        for code in codes:
            hit = hit | F.col("phone_number").startswith(code.removeprefix("+"))
        return hit

    rules = {
        "country": ("country_codes", prefixes),
        "school": ("school_names", lambda v: F.col("school_name").isin(v)),
        "phone_list": ("phone_numbers", lambda v: F.col("phone_number").isin(v)),
    }
    if kind == "all":
        if scope.get("value"):
            raise ValueError("scope all takes no value")
        return users
    chosen = [k for k in rules if kind == k or (kind == "combined" and _values(scope, rules[k][0]))]
    if not chosen or any(not _values(scope, rules[k][0]) for k in chosen):
        raise ValueError(f"invalid scope {kind!r}")
    for k in chosen:
        field, rule = rules[k]
        users = users.filter(rule(_values(scope, field)))
    return users


def scope_preview(users: DataFrame, scope: Mapping) -> DataFrame:
    """Counts of the users a scope would show."""
    registered = F.count_if(F.col("registration_completed"))
    return preview_filter(users, scope).agg(
        F.count("*").alias("count"),
        registered.alias("registered_count"),
        (F.count("*") - registered).alias("unregistered_count"),
    )


def scope_sample(users: DataFrame, scope: Mapping, n: int = 100) -> DataFrame:
    """The rows shown beside the counts."""
    return (
        preview_filter(users, scope)
        .orderBy("id")
        .limit(n)
        .select("id", "phone_number", "first_name", "school_name", "registration_completed")
    )


# P4 / P5 ---------------------------------------------------------------------


def teacher_cohort(
    users: DataFrame, unit_col: str | None, region: str | None = None, organization: str | None = None
) -> DataFrame:
    """Registered teachers who are not test users, with their unit (blank is NULL)."""
    df = users.filter(F.col("registration_completed") & ~F.coalesce("is_test_user", F.lit(False)))
    if region:
        df = df.filter(F.col("region") == region)
    if organization:
        df = df.filter(F.col("organization") == organization)
    unit = F.nullif(F.trim(unit_col), F.lit("")) if unit_col else F.lit(None).cast("string")
    return df.select("id", unit.alias("unit"))


def local_day(ts: str | Column, tz: str = "UTC") -> Column:
    """P5: the programme's calendar date of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def in_days(df: DataFrame, ts: str, lo: str, hi: str, tz: str = "UTC") -> DataFrame:
    """P5: rows whose local day is in ``[lo, hi]``, as column ``d``. The plain range with a day
    of slack on both sides reaches the scan; the zone function alone would not."""
    coarse = (F.col(ts) >= (F.lit(lo).cast("date") - 1).cast("timestamp")) & (
        F.col(ts) < (F.lit(hi).cast("date") + 2).cast("timestamp")
    )
    return (
        df.filter(coarse)
        .withColumn("d", local_day(ts, tz))
        .filter(F.col("d").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    )


# P6 - P8 ----------------------------------------------------------------------


def recent_for_key(df: DataFrame, key: str, n: int, ts: str = "created_at", newest: bool = True, value=None) -> DataFrame:
    """The first ``n`` rows by time for one key value, or for each key."""
    order = [F.col(ts).desc() if newest else F.col(ts).asc(), F.col("id").asc()]
    if value is not None:
        return df.filter(F.col(key) == value).orderBy(*order).limit(n)
    return top_n(df, [key], order, n)


def user_cards(df: DataFrame, key: str, ts: str = "created_at", latest: int = 3) -> DataFrame:
    """Per key the number of rows and the newest ``latest`` rows, one line each."""
    counts = df.groupBy(key).agg(F.count("*").alias("total"))
    return recent_for_key(df, key, latest, ts).join(counts, key)


def search_users(users: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Phone prefix for digits, else contains on the three name columns; at most 50 rows."""
    if text is None or len(text) < 3:
        return users.limit(0)
    term = text.strip().lower()
    df = users.filter(F.col("registration_completed") & F.col("phone_number").isNotNull())
    if term.isdigit() and term.isascii():
        df = df.filter(F.col("phone_number").startswith(term))
    else:
        like = f"%{term}%"
        df = df.filter(F.col("first_name").ilike(like) | F.col("last_name").ilike(like) | F.col("name").ilike(like))
    return df.orderBy("id").limit(min(limit or 20, 50))


def display_name(first: str = "first_name", last: str = "last_name", phone: str = "phone_number") -> Column:
    """Trimmed first and last name, else the phone number."""
    both = F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))
    return F.coalesce(F.nullif(F.trim(both), F.lit("")), F.col(phone))


def session_label(code: str | Column = "session_type") -> Column:
    """Readable label of a session type; NULL counts as general."""
    pairs = [F.lit(x) for pair in SESSION_LABELS.items() for x in pair]
    return F.create_map(*pairs)[F.coalesce(code, F.lit("general"))]


def country_code(phone: str = "phone_number") -> Column:
    """The first two digits of a phone number."""
    return F.left(phone, F.lit(2))


# P9 / P10 -----------------------------------------------------------------------


def exclude_answered(sessions: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Next question per session.

    ``sessions(session_id, quiz_id, level)``, ``questions(question_id, quiz_id, difficulty_level,
    sort_order)``, ``answers(session_id, question_id)``. An unanswered question at the level wins,
    else one within one level; the first in sort order. Each session meets the questions of its
    own answers only: questions are numbered per quiz and level, and the first number that the
    session's answers there leave out is the next question. The rows made are three per session
    and one per answer.
    """
    order = Window.partitionBy("quiz_id", "difficulty_level").orderBy("sort_order", "question_id")
    numbered = questions.withColumn("_nth", F.row_number().over(order))
    levels = sessions.withColumn("difficulty_level", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))).filter(
        F.col("difficulty_level").between(1, 5)
    )
    given = (
        answers.select("session_id", "question_id")
        .distinct()
        .join(numbered.select("question_id", F.col("quiz_id").alias("_quiz"), "difficulty_level", "_nth"), "question_id")
        .join(sessions.select("session_id", F.col("quiz_id").alias("_quiz")), ["session_id", "_quiz"])
    )
    place = F.row_number().over(Window.partitionBy("session_id", "difficulty_level").orderBy("_nth"))
    gaps = (
        given.withColumn("_place", place)
        .groupBy("session_id", "difficulty_level")
        .agg(F.coalesce(F.min(F.when(F.col("_nth") != F.col("_place"), F.col("_place"))), F.count("*") + 1).cast("int").alias("_gap"))
    )
    open_ = (
        levels.join(gaps, ["session_id", "difficulty_level"], "left")
        .withColumn("_nth", F.coalesce("_gap", F.lit(1)))
        .join(numbered.select("quiz_id", "difficulty_level", "_nth", "question_id", "sort_order"), ["quiz_id", "difficulty_level", "_nth"])
    )
    rank = F.struct((F.col("difficulty_level") != F.col("level")).alias("other"), "sort_order", "question_id")
    return (
        open_.groupBy("session_id", "quiz_id", "level")
        .agg(F.min_by(F.struct("question_id", "difficulty_level"), rank).alias("q"))
        .select("session_id", "quiz_id", "level", "q.question_id", "q.difficulty_level")
    )


def slow_requests(logs: DataFrame, threshold: float = 1000) -> DataFrame:
    """P10: requests with static and slow flags; health routes are left out."""
    static = F.lit(False)
    for suffix in STATIC_SUFFIXES:
        static = static | F.col("path").endswith(suffix)
    for folder in STATIC_FOLDERS:
        static = static | F.col("path").startswith(folder)
    return logs.filter(~F.col("path").isin(EXCLUDED_ROUTES)).withColumns(
        {"is_static": static, "is_slow": F.col("duration_ms") > threshold}
    )
