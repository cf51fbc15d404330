"""Programme tables derived from the given test tables.

Each table exists twice with the same definition: as a DataFrame (``Programme``)
and as a DuckDB common table expression (``PRELUDE``) for the checks. Event types
act as features, as written in FIXTURES.md.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators import windows
from chalkline.operators.ordered import number_rows, position_chunk
from chalkline.sources.tables import load

# The checks run "as of" this instant, close to the end of the events.
AS_OF = "2024-01-29 12:00:00"
DAY = "2024-01-29"
# The orders end in August 2001.
ORDER_DAY = "2001-07-20"

EVENT_COLUMNS = {
    "chat": (
        "click",
        {
            "role": "CASE WHEN value < 80 THEN 'user' ELSE 'assistant' END",
            "message_type": "CASE WHEN k < 30 THEN 'voice' ELSE 'text' END",
        },
    ),
    "lesson_plans": (
        "purchase",
        {
            "type": "CASE WHEN k < 60 THEN 'lesson_plan' ELSE 'presentation' END",
            "gamma_url": "CASE WHEN value > 50 THEN 'link' END",
        },
    ),
    "coaching": (
        "signup",
        {
            "status": "CASE WHEN value < 60 THEN 'completed' WHEN k < 50 THEN 'failed' ELSE 'processing' END",
            "score": "CASE WHEN k >= 10 THEN CAST(k AS DOUBLE) END",
            "framework": "CASE WHEN k < 40 THEN 'hots' WHEN k < 70 THEN 'teach' ELSE 'oecd' END",
        },
    ),
    "reading": (
        "error",
        {
            "status": "CASE WHEN value < 90 THEN 'completed' ELSE 'failed' END",
            "grade_level": "CASE WHEN k < 20 THEN 1 WHEN k < 40 THEN 2 WHEN k < 60 THEN 3 WHEN k < 80 THEN 4 ELSE 5 END",
            "student_identifier": "CASE WHEN k >= 20 THEN concat('S', CAST(k AS VARCHAR(10))) END",
            "wcpm": "value",
            "accuracy": "CASE WHEN k >= 5 THEN CAST(k AS DOUBLE) END",
            "on_track": "CASE WHEN k >= 10 THEN value > 40 END",
        },
    ),
    "videos": (
        "view",
        {
            "status": "CASE WHEN k < 50 THEN 'completed' WHEN k < 60 THEN 'queued' WHEN k < 70 THEN 'processing' "
            "WHEN k < 90 THEN 'failed' ELSE 'cancelled' END",
            "language": "CASE WHEN value < 30 THEN 'en' WHEN value < 70 THEN 'ur' END",
            "topic": "concat('Topic ', CAST(k AS VARCHAR(10)))",
        },
    ),
}

USERS = {
    "phone_number": "concat(CAST(10 + c_nationkey AS VARCHAR(10)), lpad(CAST(c_custkey AS VARCHAR(12)), 9, '0'))",
    "name": "c_name",
    "first_name": "substring(c_name, 1, 8)",
    "last_name": "substring(c_name, 10, 9)",
    "school_name": "CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE c_mktsegment END",
    "source": "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 4000 THEN 'website' ELSE 'direct' END",
    "preferred_language": "CASE WHEN c_acctbal < 500 THEN NULL WHEN c_acctbal < 3000 THEN 'ur' WHEN c_acctbal < 6000 THEN 'sw' ELSE 'en' END",
    "registration_completed": "c_acctbal > 1000",
    "is_test_user": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal > 9000 END",
}

SESSION_TYPE = (
    "CASE WHEN message_count = 1 AND hour(started_at) < 12 THEN 'lesson_plan' "
    "WHEN message_count = 1 AND hour(started_at) < 18 THEN 'presentation' "
    "WHEN message_count = 2 THEN 'audio_coaching' WHEN message_count = 3 THEN 'general' END"
)


def _event_cte(name: str) -> str:
    kind, columns = EVENT_COLUMNS[name]
    cols = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
    return (
        f"{name} AS (SELECT id, user_id, created_at, value, k, {cols} FROM ev WHERE event_type = '{kind}')"
    )


_USER_COLS = ", ".join(f"{expr} AS {col}" for col, expr in USERS.items())

PRELUDE = (
    "WITH ev AS (SELECT event_id AS id, user_id, ts AS created_at, event_type, value, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events), "
    + ", ".join(_event_cte(name) for name in EVENT_COLUMNS)
    + ", first_seen AS (SELECT user_id, min(created_at) AS first_at FROM ev GROUP BY user_id), "
    f"users AS (SELECT c_custkey AS id, {_USER_COLS}, "
    "CASE WHEN c_acctbal > 1000 THEN first_at + INTERVAL 1 DAY END AS registration_completed_at, "
    "first_at AS created_at FROM customer LEFT JOIN first_seen ON user_id = c_custkey), "
    "marked AS (SELECT *, CASE WHEN lag(created_at) OVER w IS NULL "
    "OR created_at - lag(created_at) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS is_new "
    "FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)), "
    "numbered AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY created_at, id "
    "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM marked), "
    "session_base AS (SELECT user_id, session_no, min(created_at) AS started_at, max(created_at) AS ended_at, "
    "count(*) AS message_count FROM numbered GROUP BY user_id, session_no), "
    f"chat_sessions AS (SELECT *, {SESSION_TYPE} AS session_type FROM session_base)"
)


# Answers: an order is a quiz session, its lines in order are the answers, the supplier is the question.
KEY_OPTION = "CASE WHEN s_acctbal < 2000 THEN 'A' WHEN s_acctbal < 6000 THEN 'B' ELSE 'C' END"
PICK = "CASE WHEN l_tax = 0.08 THEN NULL WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'B' ELSE 'C' END"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
ANSWERS = (
    f"answers AS (SELECT l_orderkey AS session_id, l_suppkey AS question_id, {PICK} AS selected_option, "
    f"coalesce({PICK} = {KEY_OPTION}, false) AS is_correct, l_quantity, l_extendedprice, l_returnflag, "
    f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS pos "
    "FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"
)
QUIZ = (
    "WITH "
    + ANSWERS
    + ", questions AS (SELECT s_suppkey AS question_id, quiz_id, concat('Question ', CAST(s_suppkey AS VARCHAR)) AS question_text, "
    f"{KEY_OPTION} AS correct_option, concat(s_name, ' a') AS option_a, concat(s_name, ' b') AS option_b, concat(s_name, ' c') AS option_c, "
    "CASE WHEN s_acctbal > 4000 THEN 'general note' END AS misconception_feedback, s_acctbal > 7000 AS noted, s_suppkey AS sort_order "
    "FROM supplier CROSS JOIN (SELECT DISTINCT o_orderpriority AS quiz_id FROM orders)), "
    "quiz_runs AS (SELECT o_orderkey AS session_id, o_orderpriority AS quiz_id, CAST(o_custkey AS VARCHAR) AS student_name, "
    "CASE WHEN o_orderstatus = 'F' THEN 'in_progress' ELSE 'completed' END AS status, "
    "CAST(floor(o_totalprice / 5000) AS INTEGER) AS mastery_percentage, o_orderdate AS share_code_id FROM orders)"
)


def over_quiz(body: str) -> str:
    body = body.strip()
    if body.upper().startswith("WITH "):
        return QUIZ + ", " + body[5:]
    return QUIZ + " " + body


def over_programme(body: str) -> str:
    """DuckDB text of ``body`` with the programme tables in scope. ``body`` may add more CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return PRELUDE + ", " + body[5:]
    return PRELUDE + " " + body


class Programme:
    """The same tables as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, name, f"{self.folder}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.col("ts").alias("created_at"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    def feature(self, name: str) -> DataFrame:
        kind, columns = EVENT_COLUMNS[name]
        return self.ev.filter(F.col("event_type") == kind).select(
            "id", "user_id", "created_at", "value", "k", *[F.expr(e).alias(c) for c, e in columns.items()]
        )

    @cached_property
    def chat(self) -> DataFrame:
        return self.feature("chat")

    @cached_property
    def lesson_plans(self) -> DataFrame:
        return self.feature("lesson_plans")

    @cached_property
    def coaching(self) -> DataFrame:
        return self.feature("coaching")

    @cached_property
    def reading(self) -> DataFrame:
        return self.feature("reading")

    @cached_property
    def videos(self) -> DataFrame:
        return self.feature("videos")

    @cached_property
    def users(self) -> DataFrame:
        first = self.ev.groupBy("user_id").agg(F.min("created_at").alias("first_at"))
        joined = self.table("customer").join(first, F.col("user_id") == F.col("c_custkey"), "left")
        return joined.select(
            F.col("c_custkey").alias("id"),
            *[F.expr(e).alias(c) for c, e in USERS.items()],
            F.when(F.col("c_acctbal") > 1000, F.col("first_at") + F.expr("INTERVAL 1 DAY")).alias(
                "registration_completed_at"
            ),
            F.col("first_at").alias("created_at"),
        )

    @cached_property
    def chat_sessions(self) -> DataFrame:
        sessions = windows.sessions(windows.sessionize(self.ev, "user_id", "created_at", "id", 6 * 60))
        return sessions.withColumn("session_type", F.expr(SESSION_TYPE))

    def _answers(self, lines: DataFrame, *more: str) -> DataFrame:
        keys = self.table("supplier").select("s_suppkey", F.expr(KEY_OPTION).alias("key_option"))
        picked = lines.withColumn("selected_option", F.expr(PICK)).join(keys, F.col("s_suppkey") == F.col("l_suppkey"))
        return picked.select(
            F.col("l_orderkey").alias("session_id"),
            F.col("l_suppkey").alias("question_id"),
            "selected_option",
            F.coalesce(F.col("selected_option") == F.col("key_option"), F.lit(False)).alias("is_correct"),
            "l_quantity",
            "l_extendedprice",
            "l_returnflag",
            *more,
        )

    @cached_property
    def picks(self) -> DataFrame:
        """Answers without their place."""
        return self._answers(self.table("lineitem"))

    @cached_property
    def answers(self) -> DataFrame:
        """Answers with their place in the session."""
        lines = number_rows(self.table("lineitem"), ["l_orderkey"], LINE_ORDER, "pos", position_chunk("l_linenumber"))
        return self._answers(lines, "pos")

    @cached_property
    def questions(self) -> DataFrame:
        quizzes = self.table("orders").select(F.col("o_orderpriority").alias("quiz_id")).distinct()
        note = F.create_map(F.lit("A"), F.lit("note A"), F.lit("B"), F.lit("note B"), F.lit("C"), F.lit("note C"))
        by_index = F.create_map(F.lit("0"), F.lit("A) first"), F.lit("1"), F.lit("B) second"))
        return self.table("supplier").crossJoin(F.broadcast(quizzes)).select(  # five quizzes
            F.col("s_suppkey").alias("question_id"),
            "quiz_id",
            F.concat(F.lit("Question "), F.col("s_suppkey").cast("string")).alias("question_text"),
            F.expr(KEY_OPTION).alias("correct_option"),
            F.concat("s_name", F.lit(" a")).alias("option_a"),
            F.concat("s_name", F.lit(" b")).alias("option_b"),
            F.concat("s_name", F.lit(" c")).alias("option_c"),
            F.when(F.col("s_acctbal") > 4000, "general note").alias("misconception_feedback"),
            F.when(F.col("s_acctbal") > 7000, note).alias("distractor_misconceptions"),
            F.when(F.col("s_acctbal") > 3000, by_index).alias("option_feedback"),
            F.col("s_suppkey").alias("sort_order"),
        )

    @cached_property
    def quiz_runs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("session_id"),
            F.col("o_orderpriority").alias("quiz_id"),
            F.col("o_custkey").cast("string").alias("student_name"),
            F.when(F.col("o_orderstatus") == "F", "in_progress").otherwise("completed").alias("status"),
            F.floor(F.col("o_totalprice") / 5000).cast("int").alias("mastery_percentage"),
            F.col("o_orderdate").alias("share_code_id"),
        )
