"""Registered P queries."""

from pyspark.sql import functions as F

from chalkline.operators import filters as P
from chalkline.operators import joins as J
from chalkline.plans.registry import query
from chalkline.plans.standins import DAY, Programme, over_programme

_SCOPED = (
    "SELECT *, left(phone_number, 2) AS country_code, lower(coalesce(school_name, '')) AS school_name_lower, "
    "coalesce(is_test_user, false) AS test FROM users"
)


@query(
    "P1_filter_page",
    over_programme("""
    SELECT v.id, v.user_id, topic, status, language, v.created_at, phone_number
    FROM videos v JOIN users u ON u.id = v.user_id
    WHERE status IN ('processing', 'queued') AND v.created_at >= TIMESTAMP '2024-01-03 00:00:00'
      AND v.created_at <= TIMESTAMP '2024-01-28 23:59:59' AND topic ILIKE '%TOPIC 5%'
    ORDER BY v.created_at DESC, v.id LIMIT 20 OFFSET 20"""),
)
def p1(spark, folder):
    p = Programme(spark, folder)
    rows = P.filter_requests(p.videos, p.users, "processing", None, "2024-01-03", "2024-01-28", None, "topic 5")
    return P.page_of(rows, 2, 20).select("id", "user_id", "topic", "status", "language", "created_at", "phone_number")


@query(
    "P1_filter_totals",
    over_programme("""
    SELECT count(*) AS total, count(*) > 40 AS has_more FROM videos v JOIN users u ON u.id = v.user_id
    WHERE status = 'completed' AND language = 'en'"""),
)
def p1_totals(spark, folder):
    p = Programme(spark, folder)
    return P.page_totals(P.filter_requests(p.videos, p.users, "completed", "en"), 2, 20)


@query(
    "P2_scope_country",
    over_programme(f"SELECT id, phone_number, school_name FROM ({_SCOPED}) WHERE NOT test AND country_code IN ('12', '25')"),
)
def p2_country(spark, folder):
    users = P.scope_columns(Programme(spark, folder).users)
    scope = {"type": "country", "value": {"country_codes": ["+12", "25 "]}}
    return P.apply_scope(users, scope).select("id", "phone_number", "school_name")


@query(
    "P2_scope_combined",
    over_programme(
        f"SELECT id, phone_number, school_name FROM ({_SCOPED}) WHERE NOT test AND "
        "(country_code IN ('12') OR school_name_lower IN ('building') OR phone_number IN ('29000000001'))"
    ),
)
def p2_combined(spark, folder):
    users = P.scope_columns(Programme(spark, folder).users)
    scope = {
        "type": "combined",
        "value": {"country_codes": ["12"], "school_names": [" Building"], "phone_numbers": ["29000000001"]},
    }
    return P.apply_scope(users, scope).select("id", "phone_number", "school_name")


@query(
    "P3_scope_preview",
    over_programme("""
    SELECT count(*) AS count, count(*) FILTER (WHERE registration_completed) AS registered_count,
      count(*) - count(*) FILTER (WHERE registration_completed) AS unregistered_count
    FROM users WHERE (phone_number LIKE '1%' OR phone_number LIKE '20%') AND school_name IN ('BUILDING', 'FURNITURE')"""),
)
def p3(spark, folder):
    scope = {"type": "combined", "value": {"country_codes": ["1", "20"], "school_names": ["BUILDING", "FURNITURE"]}}
    return P.scope_preview(Programme(spark, folder).users, scope)


@query(
    "P3_scope_sample",
    over_programme("""
    SELECT id, phone_number, first_name, school_name, registration_completed FROM users
    WHERE phone_number LIKE '1%' ORDER BY id LIMIT 100"""),
)
def p3_sample(spark, folder):
    return P.scope_sample(Programme(spark, folder).users, {"type": "country", "value": {"country_codes": ["+1"]}})


@query(
    "P4_teacher_cohort",
    over_programme("""
    SELECT id, nullif(trim(school_name), '') AS unit FROM users
    WHERE registration_completed AND NOT coalesce(is_test_user, false)"""),
)
def p4(spark, folder):
    return P.teacher_cohort(Programme(spark, folder).users, "school_name")


@query(
    "P5_local_day",
    over_programme("""
    SELECT id, CAST(created_at + INTERVAL 5 HOUR AS DATE) AS d FROM ev
    WHERE CAST(created_at + INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""),
)
def p5(spark, folder):
    return P.in_days(Programme(spark, folder).ev, "created_at", "2024-01-05", "2024-01-20", "Asia/Karachi").select("id", "d")


@query(
    "P6_recent_for_key",
    over_programme("""
    SELECT l.user_id, id, created_at, rank, total FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM lesson_plans) l
      JOIN (SELECT user_id, count(*) AS total FROM lesson_plans GROUP BY user_id) t ON l.user_id = t.user_id
    WHERE rank <= 3"""),
)
def p6(spark, folder):
    cards = P.user_cards(Programme(spark, folder).lesson_plans, "user_id")
    return cards.select("user_id", "id", "created_at", "rank", "total")


@query(
    "P7_search_users",
    over_programme("""
    SELECT id, name FROM users WHERE registration_completed AND phone_number IS NOT NULL
      AND (first_name ILIKE '%r#00000012%' OR last_name ILIKE '%r#00000012%' OR name ILIKE '%r#00000012%')
    ORDER BY id LIMIT 50"""),
)
def p7(spark, folder):
    return P.search_users(Programme(spark, folder).users, "R#00000012", 500).select("id", "name")


@query(
    "P7_search_phone",
    over_programme("""
    SELECT id, phone_number FROM users WHERE registration_completed AND phone_number LIKE '250000%' ORDER BY id LIMIT 20"""),
)
def p7_phone(spark, folder):
    return P.search_users(Programme(spark, folder).users, "250000").select("id", "phone_number")


@query(
    "P8_labels",
    over_programme("""
    SELECT s.user_id, session_no, coalesce(nullif(trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''))), ''), phone_number) AS display_name,
      left(phone_number, 2) AS country_code,
      CASE coalesce(session_type, 'general') WHEN 'lesson_plan' THEN 'Lesson Plan' WHEN 'presentation' THEN 'Presentation'
        WHEN 'general' THEN 'General Chat' WHEN 'audio_coaching' THEN 'Audio Coaching' END AS label
    FROM chat_sessions s JOIN users u ON u.id = s.user_id"""),
)
def p8(spark, folder):
    p = Programme(spark, folder)
    joined = p.chat_sessions.join(p.users.withColumnRenamed("id", "uid").drop("created_at"), F.col("uid") == F.col("user_id"))
    return joined.select(
        "user_id",
        "session_no",
        P.display_name().alias("display_name"),
        P.country_code().alias("country_code"),
        P.session_label().alias("label"),
    )


_LEVEL = "CASE WHEN {c} < 1000 THEN 1 WHEN {c} < 3000 THEN 2 WHEN {c} < 5500 THEN 3 WHEN {c} < 8000 THEN 4 ELSE 5 END"


@query(
    "P9_next_question",
    f"""WITH s AS (SELECT c_custkey AS session_id, c_nationkey AS quiz_id, {_LEVEL.format(c='c_acctbal')} AS level FROM customer),
    q AS (SELECT s_suppkey AS question_id, s_nationkey AS quiz_id, s_suppkey AS sort_order, {_LEVEL.format(c='s_acctbal')} AS difficulty_level FROM supplier),
    a AS (SELECT DISTINCT o_custkey AS session_id, l_suppkey AS question_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    c AS (SELECT s.session_id, s.quiz_id, level, q.question_id, difficulty_level,
        row_number() OVER (PARTITION BY s.session_id ORDER BY difficulty_level <> level, sort_order) AS rn
      FROM s JOIN q ON q.quiz_id = s.quiz_id AND abs(difficulty_level - level) <= 1
      WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.session_id = s.session_id AND a.question_id = q.question_id))
    SELECT session_id, quiz_id, level, question_id, difficulty_level FROM c WHERE rn = 1""",
)
def p9(spark, folder):
    p = Programme(spark, folder)
    sessions = p.table("customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("quiz_id"), F.expr(_LEVEL.format(c="c_acctbal")).alias("level")
    )
    questions = p.table("supplier").select(
        F.col("s_suppkey").alias("question_id"),
        F.col("s_nationkey").alias("quiz_id"),
        F.col("s_suppkey").alias("sort_order"),
        F.expr(_LEVEL.format(c="s_acctbal")).alias("difficulty_level"),
    )
    answers = (
        p.table("lineitem")
        .join(p.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.col("o_custkey").alias("session_id"), F.col("l_suppkey").alias("question_id"))
    )
    return P.exclude_answered(sessions, questions, answers)


@query(
    "P10_slow_requests",
    """WITH logs AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, length(html) AS duration_ms FROM pages)
    SELECT page_id, path, duration_ms,
      regexp_matches(path, '[.](css|js|png|jpg|svg|ico|woff|woff2)$') OR regexp_matches(path, '^/(assets|css|js|images)/') AS is_static,
      duration_ms > 2000 AS is_slow FROM logs WHERE path NOT IN ('/health', '/favicon.ico')""",
)
def p10(spark, folder):
    logs = Programme(spark, folder).table("pages").select(
        "page_id",
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"),
        F.length("html").cast("bigint").alias("duration_ms"),
    )
    return P.slow_requests(logs, 2000)
