"""Typed table scans. Every table is declared; a drifted file is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Spark DDL per table. Time columns are instants in UTC.
DECLARED: dict[str, str] = {
    # programme tables
    "users": (
        "id string, phone_number string, name string, first_name string, last_name string, "
        "school_name string, region string, organization string, preferred_language string, "
        "source string, registration_completed boolean, registration_completed_at timestamp, "
        "is_test_user boolean, created_at timestamp"
    ),
    "chat_messages": (
        "id string, user_id string, session_id string, role string, message_type string, "
        "content string, created_at timestamp"
    ),
    "chat_sessions": (
        "id string, user_id string, started_at timestamp, last_activity_at timestamp, "
        "ended_at timestamp, message_count int, session_type string"
    ),
    "coaching_sessions": (
        "id string, user_id string, status string, analysis_data string, "
        "transcription_cost decimal(18,4), analysis_cost decimal(18,4), created_at timestamp, "
        "transcription_started_at timestamp, transcription_completed_at timestamp, "
        "analysis_started_at timestamp, analysis_completed_at timestamp, completed_at timestamp, "
        "tokens_raw array<struct<text:string,start_ms:bigint,end_ms:bigint,language:string>>"
    ),
    "lesson_plans": (
        "id string, user_id string, topic string, grade string, subject string, type string, "
        "gamma_url string, created_at timestamp"
    ),
    "reading_assessments": (
        "id string, user_id string, student_identifier string, grade_level int, language string, "
        "passage_type string, passage_text string, transcript_text string, "
        "word_timestamps array<struct<word:string,startMs:bigint,endMs:bigint>>, "
        "audio_duration_seconds double, wcpm double, accuracy_percentage double, on_track boolean, "
        "comprehension_answers array<struct<correct:boolean>>, status string, created_at timestamp"
    ),
    "wcpm_percentiles": "grade_level int, language string, season string, percentile int, wcpm_threshold int",
    "lcpm_benchmarks": (
        "grade_level int, language string, season string, percentile_5 int, percentile_10 int, "
        "percentile_25 int, percentile_50 int, percentile_75 int, percentile_90 int"
    ),
    "students": (
        "id string, list_id string, roll_number int, student_name string, father_name string, "
        "is_active boolean, created_at timestamp"
    ),
    "attendance_sessions": (
        "id string, list_id string, session_date date, total_students int, present_count int, absent_count int"
    ),
    "attendance_records": "session_id string, student_id string, status string, created_at timestamp",
    "video_requests": (
        "id string, user_id string, topic string, language string, status string, "
        "created_at timestamp, completed_at timestamp"
    ),
    "quiz_sessions": (
        "id string, quiz_id string, student_id string, student_name string, share_code_id string, "
        "invited_by_student_id string, status string, total_questions_answered int, correct_answers int, "
        "mastery_percentage int, mastery_level string, created_at timestamp, completed_at timestamp"
    ),
    "quiz_answers": (
        "session_id string, question_id string, selected_option string, is_correct boolean, created_at timestamp"
    ),
    "quiz_questions": (
        "id string, quiz_id string, question_text string, option_a string, option_b string, option_c string, "
        "option_d string, correct_option string, option_feedback map<string,string>, "
        "distractor_misconceptions map<string,string>, difficulty_level int, sort_order int"
    ),
    "ab_variants": "test_id string, variant_name string, successes bigint, failures bigint, impressions bigint, conversions bigint",
    "ab_events": "test_id string, variant_name string, event_type string, created_at timestamp",
    "exam_grades": "submission_id string, question_id string, max_marks decimal(18,4), awarded_marks decimal(18,4)",
    "usage_log": "service string, units decimal(18,4), cost decimal(18,4), created_at timestamp",
    "website_visits": "session_id string, utm_source string, referrer string, ip_hash string, created_at timestamp",
    # the tables the checks run on
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def declared(name: str) -> T.StructType:
    if name not in DECLARED:
        raise KeyError(f"no declared schema for table {name!r}")
    return T.StructType.fromDDL(DECLARED[name])


def check_schema(name: str, found: T.StructType) -> None:
    """Raise when a declared column is missing or has another type."""
    have = {field.name: field.dataType for field in found}
    problems = []
    for field in declared(name):
        got = have.get(field.name)
        if got is None:
            problems.append(f"{field.name}: missing")
        elif not _same_type(field.dataType, got):
            problems.append(f"{field.name}: {got.simpleString()} instead of {field.dataType.simpleString()}")
    if problems:
        raise ValueError(f"table {name!r} has drifted: " + "; ".join(problems))


def _same_type(want: T.DataType, got: T.DataType) -> bool:
    if isinstance(want, T.TimestampType) and isinstance(got, T.TimestampNTZType):
        return True
    return want.simpleString() == got.simpleString()


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Scan ``path`` as table ``name`` with its declared columns. The files' own schema is checked
    first. Zone-less times are read as UTC by the scan itself, so filters on them still reach it."""
    check_schema(name, spark.read.parquet(path).schema)
    return spark.read.schema(declared(name)).parquet(path)
