"""Registered J queries."""

from pyspark.sql import functions as F

from chalkline.functions import norms
from chalkline.operators import joins as J
from chalkline.plans.registry import query
from chalkline.plans.standins import AS_OF, Programme, over_programme

_PER_USER = (
    "SELECT user_id, max(created_at) AS last_activity, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS nu, "
    "count(*) FILTER (WHERE message_type = 'voice') AS nv FROM chat GROUP BY user_id"
)


@query(
    "J1_users_with_activity",
    over_programme(f"""
    SELECT id, phone_number, last_activity, coalesce(n, 0) AS total_messages, coalesce(nu, 0) AS user_messages,
      coalesce(nv, 0) AS voice_messages FROM users LEFT JOIN ({_PER_USER}) ON user_id = id"""),
)
def j1(spark, folder):
    p = Programme(spark, folder)
    return J.users_with_activity(p.users, p.chat).select(
        "id", "phone_number", "last_activity", "total_messages", "user_messages", "voice_messages"
    )


@query(
    "J2_recent_activity",
    over_programme("""
    SELECT c.id, c.user_id, role, message_type, c.created_at, phone_number, name FROM chat c JOIN users u ON u.id = c.user_id
    ORDER BY c.created_at DESC, c.id LIMIT 10"""),
)
def j2(spark, folder):
    p = Programme(spark, folder)
    return J.recent_activity(p.chat, p.users, 10).select(
        "id", "user_id", "role", "message_type", "created_at", "phone_number", "name"
    )


@query(
    "J3_date_spine_join",
    over_programme("""
    WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date),
    x AS (SELECT CAST(created_at AS DATE) AS date, event_type FROM ev WHERE created_at >= TIMESTAMP '2023-12-28')
    SELECT d.date, count(*) FILTER (WHERE event_type = 'view') AS visits, count(*) FILTER (WHERE event_type = 'click') AS clicks,
      count(*) FILTER (WHERE event_type = 'signup') AS chats, count(*) FILTER (WHERE event_type = 'purchase') AS registrations
    FROM d LEFT JOIN x ON x.date = d.date GROUP BY d.date"""),
)
def j3(spark, folder):
    p = Programme(spark, folder)
    return J.date_spine_join(
        spark,
        "2023-12-28",
        "2024-01-31",
        visits=(p.videos, "created_at"),
        clicks=(p.chat, "created_at"),
        chats=(p.coaching, "created_at"),
        registrations=(p.lesson_plans, "created_at"),
    )


@query(
    "J4_audience",
    over_programme(f"""
    SELECT id, phone_number, name FROM users WHERE registration_completed AND phone_number IS NOT NULL AND phone_number LIKE '12%'
      AND id IN (SELECT user_id FROM chat WHERE role = 'user' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)"""),
)
def j4(spark, folder):
    p = Programme(spark, folder)
    return J.audience(p.users, p.chat, AS_OF, "7d", "12", ("12", "25")).select("id", "phone_number", "name")


@query(
    "J4_audience_matrix",
    over_programme(f"""
    WITH l AS (SELECT user_id, max(created_at) AS last_at FROM chat WHERE role = 'user' GROUP BY user_id),
    u AS (SELECT phone_number, last_at FROM users LEFT JOIN l ON user_id = id WHERE registration_completed),
    w AS (SELECT * FROM (VALUES ('all', 100000), ('24h', 1), ('7d', 7), ('30d', 30)) AS t(activity, days))
    SELECT activity, count(*) AS everyone, count(*) FILTER (WHERE phone_number LIKE '12%') AS country_12,
      count(*) FILTER (WHERE phone_number LIKE '25%') AS country_25
    FROM w JOIN u ON activity = 'all' OR last_at >= TIMESTAMP '{AS_OF}' - to_days(days) GROUP BY activity"""),
)
def j4_matrix(spark, folder):
    p = Programme(spark, folder)
    return J.audience_matrix(p.users, p.chat, AS_OF, ("12", "25"))


@query(
    "J5_missing_absent",
    over_programme("""
    WITH heard AS (SELECT user_id AS student_id, concat('U', CAST(user_id AS VARCHAR)) AS name FROM chat
      WHERE created_at >= TIMESTAMP '2024-01-29' GROUP BY user_id)
    SELECT student_id, name, 'present' AS status, 0.9 AS confidence, false AS auto_marked FROM heard
    UNION ALL SELECT c_custkey, c_name, 'absent', 1.0, true FROM customer WHERE c_custkey NOT IN (SELECT student_id FROM heard)"""),
)
def j5(spark, folder):
    p = Programme(spark, folder)
    day = F.col("created_at") >= F.lit("2024-01-29").cast("timestamp")
    heard = p.chat.filter(day).select(
        F.col("user_id").alias("student_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("name"),
        F.lit("present").alias("status"),
        F.lit(0.9).alias("confidence"),
    ).distinct()
    roster = p.table("customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("student_name"))
    return J.mark_missing_absent(heard, roster)


@query(
    "J6_interval_join",
    """WITH s AS (SELECT o_custkey AS user_id, min(o_orderdate) AS started_at FROM orders GROUP BY o_custkey)
    SELECT s.user_id, started_at, coalesce(bool_or(CAST(o_orderdate AS DATE) = CAST(started_at AS DATE)), false) AS day0,
      coalesce(bool_or(o_orderdate >= started_at + INTERVAL 1 DAY AND o_orderdate < started_at + INTERVAL 8 DAY), false) AS week1,
      coalesce(bool_or(o_orderdate >= started_at + INTERVAL 8 DAY AND o_orderdate < started_at + INTERVAL 60 DAY), false) AS later
    FROM s JOIN orders ON o_custkey = s.user_id GROUP BY s.user_id, started_at""",
)
def j6(spark, folder):
    orders = Programme(spark, folder).table("orders")
    starts = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderdate").alias("started_at"))
    events = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"))
    return J.interval_join(starts, events, [("week1", 1, 8), ("later", 8, 60)])


_WORD_VALUES = ", ".join(
    f"({g}, '{lng}', '{ssn}', {p}, {cut})"
    for (g, lng, ssn), cuts in norms.WORD_NORMS.items()
    for p, cut in zip(norms.PERCENTILES, cuts)
)
_LETTER_VALUES = ", ".join(
    f"({g}, '{lng}', {', '.join(str(c) for c in cuts)})" for (g, lng), cuts in norms.LETTER_NORMS.items()
)


@query(
    "J7_threshold_lookup",
    over_programme(f"""
    WITH norms AS (SELECT * FROM (VALUES {_WORD_VALUES}) AS t(g, lng, ssn, p, cut)),
    r AS (SELECT id, grade_level, CASE WHEN k < 50 THEN 'ur' ELSE 'en' END AS language, k >= 25 AS l2,
      CAST(floor(wcpm + 0.5) AS BIGINT) AS rate,
      CASE WHEN k < 33 THEN 'fall' WHEN k < 66 THEN 'winter' ELSE 'spring' END AS ssn FROM reading),
    x AS (SELECT *, CASE WHEN language = 'ur' AND l2 THEN 'ur' ELSE 'en' END AS lng FROM r),
    m AS (SELECT x.id, x.grade_level, x.lng, x.rate, max(cut) FILTER (WHERE p = 25) AS lo, max(cut) FILTER (WHERE p = 75) AS hi,
      max(p) FILTER (WHERE cut <= rate) AS reached
      FROM x LEFT JOIN norms n ON n.g = grade_level AND n.lng = x.lng AND n.ssn = x.ssn GROUP BY ALL)
    SELECT id, CAST(coalesce(lo, CASE WHEN lng = 'ur' THEN 35 ELSE 50 END) AS INTEGER) AS benchmark_min,
      CAST(coalesce(hi, CASE WHEN lng = 'ur' THEN 70 ELSE 100 END) AS INTEGER) AS benchmark_max,
      rate >= coalesce(lo, CASE WHEN lng = 'ur' THEN 35 ELSE 50 END) AS on_track_now,
      CASE WHEN rate = 0 THEN 1 ELSE coalesce(reached, 10) END AS percentile_rank FROM m"""),
)
def j7(spark, folder):
    reading = Programme(spark, folder).reading.withColumn("language", F.when(F.col("k") < 50, "ur").otherwise("en"))
    season = F.when(F.col("k") < 33, "fall").when(F.col("k") < 66, "winter").otherwise("spring")
    return J.threshold_lookup(reading, second_language=F.col("k") >= 25, season_col=season).select(
        "id", "benchmark_min", "benchmark_max", "on_track_now", "percentile_rank"
    )


@query(
    "J8_band_lookup",
    over_programme(f"""
    WITH norms AS (SELECT * FROM (VALUES {_LETTER_VALUES}) AS t(g, lng, p5, p10, p25, p50, p75, p90)),
    r AS (SELECT id, grade_level, wcpm AS lcpm, CASE WHEN k < 30 THEN 'ur' WHEN k < 60 THEN 'en' END AS language FROM reading)
    SELECT id, coalesce(p25, 20) AS benchmark_min, coalesce(p75, 60) AS benchmark_max, lcpm >= coalesce(p25, 20) AS on_track_now,
      CASE WHEN g IS NULL THEN 50 WHEN lcpm < p5 THEN 5 WHEN lcpm < p10 THEN 10 WHEN lcpm < p25 THEN 25 WHEN lcpm < p50 THEN 50
        WHEN lcpm < p75 THEN 75 WHEN lcpm < p90 THEN 90 ELSE 95 END AS percentile_rank
    FROM r LEFT JOIN norms ON g = grade_level AND lng = coalesce(language, 'en')"""),
)
def j8(spark, folder):
    reading = Programme(spark, folder).reading.withColumn(
        "language", F.when(F.col("k") < 30, "ur").when(F.col("k") < 60, "en")
    )
    return J.band_lookup(reading, "wcpm").select("id", "benchmark_min", "benchmark_max", "on_track_now", "percentile_rank")


def _sql_text(value):
    return "NULL" if value is None else (f"'{value}'" if isinstance(value, str) else str(value))


_SCALE_VALUES = ", ".join(
    f"('{name}', {low}, '{grade}', CAST({_sql_text(gpa)} AS DOUBLE), {_sql_text(division)})"
    for name, rows in norms.SCALES.items()
    for low, grade, gpa, division in rows
)


@query(
    "J9_grade_scale_join",
    over_programme(f"""
    WITH scales AS (SELECT * FROM (VALUES {_SCALE_VALUES}) AS t(scale, low, grade, gpa, division)),
    r AS (SELECT id, CAST(k AS DOUBLE) + 0.5 AS percentage, CASE WHEN value < 20 THEN 'Punjab_Matric' WHEN value < 40 THEN 'Federal'
      WHEN value < 60 THEN 'IGCSE' WHEN value < 80 THEN 'Other Board' END AS board FROM ev),
    m AS (SELECT id, percentage, board, max_by(struct_pack(grade := grade, gpa := gpa, division := division), low) AS g
      FROM r JOIN scales ON percentage >= low AND scale = CASE board WHEN 'Punjab_Matric' THEN 'matric' WHEN 'Federal' THEN 'fbise'
        WHEN 'IGCSE' THEN 'cambridge' ELSE 'generic' END GROUP BY id, percentage, board)
    SELECT id, percentage, board, g.grade AS grade, g.gpa AS gpa, g.division AS division,
      g.grade NOT IN ('F', 'Fail', 'U') AS passed FROM m"""),
)
def j9(spark, folder):
    ev = Programme(spark, folder).ev.select(
        "id",
        (F.col("k").cast("double") + 0.5).alias("percentage"),
        F.expr(
            "CASE WHEN value < 20 THEN 'Punjab_Matric' WHEN value < 40 THEN 'Federal' WHEN value < 60 THEN 'IGCSE' "
            "WHEN value < 80 THEN 'Other Board' END"
        ).alias("board"),
    )
    return J.grade_scale_join(ev)


# A quiz is an order day, a student a customer; the day's first customer invited the others.
_QUIZ_RUNS = """runs AS (SELECT o_orderkey AS session_id, o_orderdate AS quiz_id, o_custkey AS student_id,
      min(o_custkey) OVER (PARTITION BY o_orderdate) AS host, CAST(floor(o_totalprice / 50000) AS BIGINT) AS correct_answers,
      CASE WHEN o_orderstatus = 'F' THEN 'expired' ELSE 'completed' END AS status FROM orders)"""


@query(
    "J10_self_compare",
    f"""WITH {_QUIZ_RUNS}, mine AS (SELECT quiz_id, student_id, min_by(correct_answers, session_id) AS c FROM runs
        WHERE status = 'completed' GROUP BY quiz_id, student_id)
    SELECT session_id, r.student_id, host AS invited_by_student_id, correct_answers AS friend_correct, c AS inviter_correct,
      CASE WHEN correct_answers > c THEN 'ahead' WHEN correct_answers < c THEN 'behind' ELSE 'tie' END AS outcome
    FROM runs r JOIN mine m ON m.quiz_id = r.quiz_id AND m.student_id = host WHERE status = 'completed' AND host <> r.student_id""",
)
def j10(spark, folder):
    orders = Programme(spark, folder).table("orders")
    hosts = orders.groupBy(F.col("o_orderdate").alias("quiz_id")).agg(F.min("o_custkey").alias("host"))
    runs = (
        orders.select(
            F.col("o_orderkey").alias("session_id"),
            F.col("o_orderdate").alias("quiz_id"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_custkey").alias("student_id"),
            F.floor(F.col("o_totalprice") / 50000).alias("correct_answers"),
            F.when(F.col("o_orderstatus") == "F", "expired").otherwise("completed").alias("status"),
        )
        .join(hosts, "quiz_id")
        .withColumn("invited_by_student_id", F.when(F.col("host") != F.col("student_id"), F.col("host")))
    )
    return J.self_compare(runs).drop("quiz_id")


_DICE = """CASE WHEN a = b THEN 1.0 WHEN contains(b, a) THEN 0.7 + length(a) / length(b) * 0.3
  WHEN contains(a, b) THEN 0.7 + length(b) / length(a) * 0.3
  ELSE 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) END"""
_GRAMS = "list_distinct([substring({c}, i, 2) FOR i IN generate_series(1, length({c}) - 1)])"


@query(
    "J11_fuzzy_match",
    f"""WITH roster AS (SELECT p_partkey AS student_id, p_brand AS class_id, p_name AS s, p_type AS f FROM part),
    nm AS (SELECT p_partkey AS name_id, p_brand AS class_id, concat(left(p_name, 5), ' ', lower(p_type)) AS name FROM part),
    cand AS (SELECT class_id, student_id, lower(trim(s)) AS b FROM roster UNION ALL
      SELECT class_id, student_id, lower(trim(concat(s, ' ', f))) FROM roster),
    best AS (SELECT class_id, b, min(student_id) AS student_id FROM cand GROUP BY class_id, b),
    heard AS (SELECT DISTINCT class_id, lower(trim(name)) AS a FROM nm),
    scored AS (SELECT h.class_id, a, student_id, {_DICE} AS score FROM
      (SELECT h.class_id, a, b, student_id, {_GRAMS.format(c='a')} AS ga, {_GRAMS.format(c='b')} AS gb
       FROM heard h JOIN best c ON c.class_id = h.class_id) h),
    top AS (SELECT class_id, a, student_id, score, row_number() OVER (PARTITION BY class_id, a ORDER BY score DESC, student_id) AS rn
      FROM scored WHERE score > 0.4)
    SELECT name_id, nm.class_id, name, student_id, round(coalesce(score, 0.3), 6) AS confidence
    FROM nm LEFT JOIN top ON top.class_id = nm.class_id AND a = lower(trim(name)) AND rn = 1""",
)
def j11(spark, folder):
    part = Programme(spark, folder).table("part")
    roster = part.select(
        F.col("p_partkey").alias("student_id"),
        F.col("p_brand").alias("class_id"),
        F.col("p_name").alias("student_name"),
        F.col("p_type").alias("father_name"),
        F.col("p_partkey").alias("position"),
    )
    names = part.select(
        F.col("p_partkey").alias("name_id"),
        F.col("p_brand").alias("class_id"),
        F.concat(F.left("p_name", F.lit(5)), F.lit(" "), F.lower("p_type")).alias("name"),
    )
    return J.fuzzy_match(names, roster).withColumn("confidence", F.round("confidence", 6))


# Chapters are parts: keywords are the words of the name, the title is name plus type.
_TOC = """toc AS (SELECT p_type AS curriculum, p_size AS grade, p_partkey AS chapter_number,
      concat(p_name, ' with ', p_brand) AS chapter_title, string_split(p_name, ' ') AS keywords FROM part)"""


@query(
    "J12_topic_to_chapter",
    f"""WITH {_TOC},
    topics AS (SELECT p_partkey AS topic_id, p_type AS curriculum, CASE WHEN p_size < 20 THEN upper(split_part(p_name, ' ', 1))
      WHEN p_size < 35 THEN substring(p_name, 2, 6) ELSE concat('WITH ', p_brand) END AS topic FROM part),
    words AS (SELECT curriculum, unnest(keywords) AS w, grade, chapter_number, chapter_title FROM toc),
    wanted AS (SELECT DISTINCT curriculum, lower(trim(topic)) AS t FROM topics),
    exact AS (SELECT x.curriculum, t, min(struct_pack(grade := grade, chapter_number := chapter_number, chapter_title := chapter_title)) AS c
      FROM wanted x JOIN words w ON w.curriculum = x.curriculum AND w.w = t GROUP BY x.curriculum, t),
    inside AS (SELECT x.curriculum, t, min(struct_pack(grade := grade, chapter_number := chapter_number, chapter_title := chapter_title)) AS c
      FROM wanted x JOIN toc ON toc.curriculum = x.curriculum AND contains(lower(chapter_title), t)
      WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.curriculum = x.curriculum AND e.t = x.t) GROUP BY x.curriculum, t),
    found AS (SELECT *, 'keyword' AS matched_by FROM exact UNION ALL SELECT *, 'title' FROM inside)
    SELECT topic_id, topics.curriculum, topic, matched_by, c.grade AS grade, c.chapter_number AS chapter_number, c.chapter_title AS chapter_title
    FROM topics JOIN found ON found.curriculum = topics.curriculum AND t = lower(trim(topic))""",
)
def j12(spark, folder):
    part = Programme(spark, folder).table("part")
    toc = part.select(
        F.col("p_type").alias("curriculum"),
        F.col("p_size").alias("grade"),
        F.col("p_partkey").alias("chapter_number"),
        F.concat("p_name", F.lit(" with "), "p_brand").alias("chapter_title"),
        F.split("p_name", " ").alias("keywords"),
    )
    topics = part.select(
        F.col("p_partkey").alias("topic_id"),
        F.col("p_type").alias("curriculum"),
        F.expr(
            "CASE WHEN p_size < 20 THEN upper(split_part(p_name, ' ', 1)) WHEN p_size < 35 THEN substring(p_name, 2, 6) "
            "ELSE concat('WITH ', p_brand) END"
        ).alias("topic"),
    )
    return J.topic_to_chapter(topics, toc)


@query(
    "J13_resolve_selection",
    """WITH g AS (SELECT DISTINCT o_custkey AS bundle_id, l_linestatus AS subject, l_linenumber AS grade, l_suppkey AS chapter
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT bundle_id, grade, subject, chapter, s_name AS chapter_title
    FROM g JOIN supplier ON s_suppkey = chapter AND s_acctbal > 0 AND grade <= 4""",
)
def j13(spark, folder):
    p = Programme(spark, folder)
    lines = p.table("lineitem").join(p.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    group = [F.col("o_custkey").alias("bundle_id"), F.col("l_linenumber").alias("grade"), F.col("l_linestatus").alias("subject")]
    # a bundle lists few groups of few chapters: one customer's suppliers, at most the supplier table
    parts = lines.groupBy(*group).agg(F.collect_set("l_suppkey").alias("chapters"))
    selections = parts.groupBy("bundle_id").agg(
        F.sort_array(F.collect_list(F.struct("grade", "subject", "chapters"))).alias("groups")
    )
    chapters = p.table("supplier").select(
        F.explode(F.array(*[F.lit(g) for g in (1, 2, 3, 4)])).alias("grade"),
        "s_suppkey",
        "s_name",
        "s_acctbal",
    ).select(
        "grade",
        F.explode(F.array(F.lit("O"), F.lit("F"))).alias("subject"),
        F.col("s_suppkey").alias("chapter"),
        F.col("s_name").alias("chapter_title"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("file_key"),
    )
    return J.resolve_selection(selections, chapters).select("bundle_id", "grade", "subject", "chapter", "chapter_title")


@query(
    "J14_fanout_safe_counts",
    over_programme("""
    SELECT left(phone_number, 2) AS country_code, count(*) AS users, CAST(coalesce(sum(a), 0) AS BIGINT) AS lesson_plans,
      CAST(coalesce(sum(b), 0) AS BIGINT) AS coaching, CAST(coalesce(sum(c), 0) AS BIGINT) AS reading, CAST(coalesce(sum(d), 0) AS BIGINT) AS videos
    FROM users LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'signup') AS b,
      count(*) FILTER (WHERE event_type = 'error') AS c, count(*) FILTER (WHERE event_type = 'view') AS d FROM ev GROUP BY user_id)
      ON user_id = users.id WHERE NOT coalesce(is_test_user, false) GROUP BY ALL"""),
)
def j14(spark, folder):
    p = Programme(spark, folder)
    users = p.users.filter(~F.coalesce("is_test_user", F.lit(False))).withColumn("country_code", F.left("phone_number", F.lit(2)))
    return J.fanout_safe_counts(
        users, "country_code", lesson_plans=p.lesson_plans, coaching=p.coaching, reading=p.reading, videos=p.videos
    )


@query(
    "J15_broadcast_scalars",
    over_programme("""
    SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM chat) AS messages,
      (SELECT count(*) FROM orders) AS orders"""),
)
def j15(spark, folder):
    p = Programme(spark, folder)
    return J.broadcast_scalars(
        p.users.agg(F.count("*").alias("users")),
        p.chat.agg(F.count("*").alias("messages")),
        p.table("orders").agg(F.count("*").alias("orders")),
    )
