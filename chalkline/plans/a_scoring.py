"""Registered queries for A30 to A37, A39 to A42, N4 and the scalar functions."""

from pyspark.sql import functions as F

from chalkline.functions import bands, codes, letters, maths, names, text
from chalkline.operators import scoring as S
from chalkline.operators.percentiles import exact_percentiles
from chalkline.plans.registry import query
from chalkline.plans.standins import ANSWERS, AS_OF, Programme, over_programme

NOW = f"TIMESTAMP '{AS_OF}'"


def _latencies(p):
    return p.ev.select(
        F.col("event_type").alias("source"), "created_at", F.floor(F.col("value") * 1000 - 5000).cast("bigint").alias("delivery_time_ms")
    )


_LAT = f"""l AS (SELECT event_type AS source, CAST(floor(value * 1000 - 5000) AS BIGINT) AS ms FROM ev WHERE created_at > {NOW} - INTERVAL 168 HOUR),
    p AS (SELECT source, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.9) AS p90_ms, count(*) AS sample_size FROM l WHERE ms > 0 GROUP BY source)"""


@query("A30_latency_percentiles", over_programme(f"WITH {_LAT} SELECT * FROM p"))
def a30(spark, folder):
    return S.latency_percentiles(_latencies(Programme(spark, folder)), AS_OF)


@query(
    "A30_expected_wait",
    over_programme(f"""
    WITH {_LAT} SELECT *, CAST(greatest(1, floor((CASE WHEN sample_size >= 10 THEN floor(p50_ms / 1000 + 0.5) ELSE 90 END) / 60 + 0.5)) AS INTEGER) AS expected_min,
      CAST(greatest(2, floor((CASE WHEN sample_size >= 10 THEN floor(p90_ms / 1000 + 0.5) ELSE 240 END) / 60 + 0.5)) AS INTEGER) AS upper_min FROM p"""),
)
def a30_wait(spark, folder):
    return S.expected_wait(S.latency_percentiles(_latencies(Programme(spark, folder)), AS_OF), 90, 240)


@query(
    "N4_ordered_aggregates",
    """SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.25) AS q1
    FROM orders GROUP BY o_orderpriority""",
)
def n4(spark, folder):
    orders = Programme(spark, folder).table("orders")
    wanted = {"median": (0.5, "cont"), "p95": (0.95, "cont"), "q1": (0.25, "disc")}
    return exact_percentiles(orders, ["o_orderpriority"], "o_totalprice", wanted)


# Attendance: a list is a market segment, a session a day with events, a student a customer.
def _attendance(p):
    users = p.table("customer").select(F.col("c_custkey").alias("student_id"), F.col("c_mktsegment").alias("list_id"))
    marks = p.ev.select(
        F.col("user_id").alias("student_id"),
        F.to_date("created_at").alias("session_date"),
        F.col("created_at").alias("recorded_at"),
        F.when(F.col("value") < 60, "present").otherwise("absent").alias("status"),
    )
    return users, marks.join(users, "student_id")


_MARKS = """m AS (SELECT c_mktsegment AS list_id, user_id AS student_id, CAST(created_at AS DATE) AS d, created_at, CASE WHEN value < 60 THEN 'present' ELSE 'absent' END AS status
      FROM ev JOIN customer ON c_custkey = user_id)"""


@query(
    "A31_attendance_summary",
    over_programme(f"""
    WITH {_MARKS}, s AS (SELECT list_id, d, count(*) AS t, count(*) FILTER (WHERE status = 'present') AS pr FROM m WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL)
    SELECT list_id, count(*) AS total_sessions, round(avg(pr / t * 100), 2) AS avg_attendance_percentage, CAST(sum(pr) AS BIGINT) AS total_present, CAST(sum(t - pr) AS BIGINT) AS total_absent
    FROM s GROUP BY list_id"""),
)
def a31(spark, folder):
    _, marks = _attendance(Programme(spark, folder))
    sessions = marks.groupBy("list_id", "session_date").agg(
        F.count("*").alias("total_students"),
        F.count_if(F.col("status") == "present").alias("present_count"),
        F.count_if(F.col("status") == "absent").alias("absent_count"),
    )
    return S.attendance_summary(sessions, "2024-01-05", "2024-01-25")


_DAYS = range(1, 32)
_LAST = "z AS (SELECT list_id, student_id, day(d) AS day, CASE WHEN max_by(status, (created_at, status)) = 'present' THEN 'P' ELSE 'A' END AS mark FROM m WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY ALL)"


@query(
    "A32_attendance_register",
    over_programme(f"""
    WITH {_MARKS}, {_LAST}, w AS (SELECT student_id, {', '.join(f"max(mark) FILTER (WHERE day = {d}) AS d{d:02d}" for d in _DAYS)},
      CAST(count(*) FILTER (WHERE mark = 'P') AS INTEGER) AS present, CAST(count(*) FILTER (WHERE mark = 'A') AS INTEGER) AS absent FROM z GROUP BY student_id)
    SELECT c_custkey AS student_id, c_mktsegment AS list_id, {', '.join(f'd{d:02d}' for d in _DAYS)}, coalesce(present, 0) AS present, coalesce(absent, 0) AS absent,
      CAST(coalesce(floor(present / (present + absent) * 100 + 0.5), 0) AS BIGINT) AS percentage FROM customer LEFT JOIN w ON student_id = c_custkey"""),
)
def a32(spark, folder):
    students, marks = _attendance(Programme(spark, folder))
    return S.attendance_register(students, marks, 2024, 1)


@query(
    "A32_day_totals",
    over_programme(f"""
    WITH {_MARKS}, {_LAST} SELECT list_id, CAST(day AS INTEGER) AS day, count(*) FILTER (WHERE mark = 'P') AS present, count(*) FILTER (WHERE mark = 'A') AS absent,
      isodow(make_date(2024, 1, day)) >= 6 AS is_weekend FROM z GROUP BY list_id, day"""),
)
def a32_days(spark, folder):
    _, marks = _attendance(Programme(spark, folder))
    return S.register_day_totals(marks, 2024, 1)


_RESPONSE = "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'declined' ELSE 'ignored' END"


@query(
    "A33_video_quiz_popularity",
    f"""WITH d AS (SELECT l_shipdate AS delivered_at, l_linenumber AS grade, l_linestatus AS subject, CASE WHEN l_discount > 0.02 THEN l_shipdate END AS offered, {_RESPONSE} AS r,
      CASE WHEN l_tax > 0.01 THEN l_orderkey END AS sid FROM lineitem)
    SELECT CAST(delivered_at AS DATE) AS day, grade, subject, count(*) AS videos_sent, count(offered) AS quizzes_offered, count(*) FILTER (WHERE r = 'accepted') AS quizzes_started,
      count(*) FILTER (WHERE o_orderstatus = 'O') AS quizzes_completed, count(*) FILTER (WHERE r = 'declined') AS quizzes_declined, count(*) FILTER (WHERE r = 'ignored') AS offers_ignored,
      round(100.0 * count(*) FILTER (WHERE r = 'accepted') / nullif(count(offered), 0), 1) AS accept_rate_pct FROM d LEFT JOIN orders ON o_orderkey = sid GROUP BY 1, 2, 3""",
)
def a33(spark, folder):
    p = Programme(spark, folder)
    deliveries = p.table("lineitem").select(
        F.col("l_shipdate").alias("delivered_at"),
        F.col("l_linenumber").alias("grade"),
        F.col("l_linestatus").alias("subject"),
        F.when(F.col("l_discount") > 0.02, F.col("l_shipdate")).alias("quiz_offered_at"),
        F.expr(_RESPONSE).alias("quiz_response"),
        F.when(F.col("l_tax") > 0.01, F.col("l_orderkey")).alias("quiz_session_id"),
    )
    sessions = p.table("orders").select(
        F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "O", "completed").otherwise("open").alias("status")
    )
    return S.video_quiz_popularity(deliveries, sessions)


_AB = "CASE WHEN event_type = 'purchase' THEN 'conversion' WHEN event_type IN ('click', 'view') THEN 'impression' ELSE 'bounce' END"
_AB_COUNTS = f"""c AS (SELECT c_mktsegment AS test_id, concat('V', CAST(CAST(floor(k / 34) AS INTEGER) AS VARCHAR)) AS variant_name, count(*) FILTER (WHERE t = 'impression') AS impressions,
      count(*) FILTER (WHERE t = 'conversion') AS conversions, count(*) FILTER (WHERE t = 'bounce') AS bounces
    FROM (SELECT *, {_AB} AS t FROM ev) JOIN customer ON c_custkey = user_id GROUP BY ALL)"""


def _ab(p):
    events = p.ev.join(p.table("customer"), F.col("c_custkey") == F.col("user_id"))
    return S.ab_event_counts(
        events.select(
            F.col("c_mktsegment").alias("test_id"),
            F.concat(F.lit("V"), F.floor(F.col("k") / 34).cast("int").cast("string")).alias("variant_name"),
            F.expr(_AB).alias("event_type"),
        )
    )


@query("A35_ab_event_counts", over_programme(f"WITH {_AB_COUNTS} SELECT *, conversions AS successes, bounces AS failures FROM c"))
def a35(spark, folder):
    return _ab(Programme(spark, folder))


@query(
    "A34_wilson_stats",
    over_programme(f"""
    WITH {_AB_COUNTS}, v AS (SELECT *, CAST(conversions AS DOUBLE) / impressions AS p, CAST(impressions AS DOUBLE) AS n, CAST(1.96 AS DOUBLE) AS z FROM c)
    SELECT test_id, variant_name, impressions, conversions, round(p * 100, 2) AS conversion_rate,
      round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS wilson_lower,
      round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS wilson_upper FROM v"""),
)
def a34(spark, folder):
    stats = S.wilson_stats(_ab(Programme(spark, folder)))
    return stats.select(
        "test_id", "variant_name", "impressions", "conversions", "conversion_rate",
        F.round("wilson_lower", 6).alias("wilson_lower"), F.round("wilson_upper", 6).alias("wilson_upper"),
    )


@query("A34_win_probabilities")
def a34_wins(spark, folder):
    return S.ab_variant_stats(_ab(Programme(spark, folder)))


@query(
    "A36_language_stats",
    over_programme("SELECT coalesce(preferred_language, 'en') AS language, count(*) AS users FROM users GROUP BY 1"),
)
def a36(spark, folder):
    return S.language_stats(Programme(spark, folder).users)


_LANG = "CASE l_returnflag WHEN 'A' THEN 'EN-us' WHEN 'R' THEN CASE WHEN l_quantity < 40 THEN 'pa' ELSE 'xx' END ELSE CASE WHEN l_tax > 0.02 THEN 'ur' END END"


@query(
    "A36_dominant_language",
    f"""WITH t AS (SELECT l_orderkey AS session_id, CASE {_LANG} WHEN 'EN-us' THEN 'en' WHEN 'pa' THEN 'pa-PK' WHEN 'ur' THEN 'ur' END AS lang FROM lineitem),
    c AS (SELECT session_id, lang, count(*) AS n FROM t WHERE lang IS NOT NULL GROUP BY ALL),
    s AS (SELECT session_id, max(n) / sum(n) AS confidence, min_by(lang, (-n, lang)) AS best FROM c GROUP BY session_id)
    SELECT x.session_id, total_tokens, coalesce(confidence, 0.0) AS confidence, CASE WHEN confidence > 0.5 THEN best END AS language
    FROM (SELECT session_id, count(*) AS total_tokens FROM t GROUP BY session_id) x LEFT JOIN s ON s.session_id = x.session_id""",
)
def a36_dominant(spark, folder):
    tokens = Programme(spark, folder).table("lineitem").select(F.col("l_orderkey").alias("session_id"), F.expr(_LANG).alias("language"))
    return S.dominant_language(tokens)


@query(
    "A37_usage_costs",
    over_programme(f"""
    WITH u AS (SELECT event_type AS service, CAST(sum(k) AS DOUBLE) AS units, count(*) AS calls, sum(CAST(floor(value) AS BIGINT)) AS logged FROM ev WHERE created_at >= date_trunc('month', {NOW}) GROUP BY 1),
    p AS (SELECT *, units / CASE service WHEN 'click' THEN 50000 WHEN 'view' THEN 117000 ELSE 130000 END * 100 AS pct, CASE service WHEN 'click' THEN units * 0.1 ELSE logged END AS c FROM u)
    SELECT service, units, calls, round(c, 2) AS cost, round(c * 2, 2) AS projected_cost, round(least(pct, 100.0), 2) AS percentage,
      CASE WHEN pct >= 90 THEN 'critical' WHEN pct >= 75 THEN 'warning' ELSE 'healthy' END AS status FROM p"""),
)
def a37(spark, folder):
    usage = Programme(spark, folder).ev.select(
        F.col("event_type").alias("service"), "created_at", F.col("k").cast("double").alias("units"), F.floor("value").cast("double").alias("cost")
    )
    limits = {"click": 50000.0, "view": 117000.0, "error": 130000.0, "purchase": 130000.0, "signup": 130000.0}
    return S.usage_costs(usage, AS_OF, limits, {"click": 0.1})


_T10 = "floor(({x}) * 10 + 0.5) / 10"


@query(
    "A39_reading_overview",
    over_programme(f"""
    SELECT user_id, count(*) AS total_assessments, {_T10.format(x='CAST(sum(CAST(wcpm AS DECIMAL(18, 2))) AS DOUBLE) / count(*)')} AS average_wcpm, {_T10.format(x='sum(coalesce(accuracy, 0)) / count(*)')} AS average_accuracy,
      count(DISTINCT coalesce(student_identifier, '')) AS students_assessed, max_by(id, (created_at, id)) AS latest_id, max(created_at) AS latest_at
    FROM reading WHERE status = 'completed' GROUP BY user_id"""),
)
def a39(spark, folder):
    return S.reading_overview(Programme(spark, folder).reading)


@query(
    "A39_reading_trend",
    over_programme("SELECT user_id, id, created_at AS date, wcpm, coalesce(accuracy, 0) AS accuracy, student_identifier AS student_name FROM reading WHERE status = 'completed'"),
)
def a39_trend(spark, folder):
    return S.reading_trend(Programme(spark, folder).reading)


@query(
    "A40_coaching_overview",
    """WITH d AS (SELECT o_custkey AS user_id, o_orderkey AS id, o_orderdate AS created_at, CAST(floor(o_totalprice / 5000) AS INTEGER) AS s, o_orderpriority AS pr FROM orders WHERE o_orderstatus <> 'F'),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn, CASE WHEN pr = '1-URGENT' THEN 0 ELSE s END AS sc FROM d),
    u AS (SELECT user_id, count(*) AS total_sessions, floor(avg(sc) * 10 + 0.5) / 10 AS average_score, CAST(max_by(sc, (created_at, id)) - min_by(sc, (created_at, id)) AS DOUBLE) AS improvement FROM g GROUP BY user_id),
    p AS (SELECT user_id, unnest([{'r': 0, 'n': 'Formative Assessment', 'v': floor(s * 0.2 / 22 * 1000 + 0.5) / 10}, {'r': 1, 'n': 'Student Engagement', 'v': floor((100 - s) * 0.1 / 22 * 1000 + 0.5) / 10},
      {'r': 2, 'n': 'Quality Content', 'v': 0.0}, {'r': 3, 'n': 'Effective Differentiation', 'v': floor(s * 0.05 / 5 * 1000 + 0.5) / 10}, {'r': 4, 'n': 'Classroom Management', 'v': 0.0}, {'r': 5, 'n': 'Reflective Debrief', 'v': 0.0}]) AS q FROM g WHERE rn = 1)
    SELECT u.*, b.best_goal, b.focus_goal FROM u JOIN (SELECT user_id, max_by(q.n, (q.v, -q.r)) AS best_goal, min_by(q.n, (q.v, -q.r)) AS focus_goal FROM p GROUP BY user_id) b ON b.user_id = u.user_id""",
)
def a40(spark, folder):
    s = F.floor(F.col("o_totalprice") / 5000).cast("int")
    scores = F.struct(
        F.when(F.col("o_orderpriority") != "1-URGENT", s).alias("overall_marks"),
        (s * 0.2).alias("goal1_total"),
        ((100 - s) * 0.1).alias("goal2_total"),
        (s * 0.05).alias("goal4_total"),
    )
    rows = Programme(spark, folder).table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        F.to_json(F.struct(scores.alias("scores"))).alias("analysis_data"),
    )
    return S.coaching_overview(rows)


@query(
    "A41_job_durations",
    """SELECT event_id AS id, CAST(floor((epoch_us(ts + INTERVAL 1 SECOND * CAST(floor(value) AS INTEGER)) - epoch_us(ts)) / 1000000 + 0.5) AS BIGINT) AS processing_seconds,
      CAST(90 AS BIGINT) AS transcription_seconds, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) - 90 END AS analysis_seconds,
      floor(value) + CASE WHEN event_type = 'click' THEN 0 ELSE 2 END AS total_cost FROM events""",
)
def a41(spark, folder):
    ev = Programme(spark, folder).table("events")
    end = F.timestamp_seconds(F.unix_micros("ts") / 1_000_000 + F.floor("value"))
    mid = F.col("ts") + F.expr("INTERVAL 90 SECOND")
    rows = ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        end.alias("completed_at"),
        F.col("ts").alias("transcription_started_at"),
        mid.alias("transcription_completed_at"),
        mid.alias("analysis_started_at"),
        F.when(F.col("event_type") != "error", end).alias("analysis_completed_at"),
        F.floor("value").cast("double").alias("transcription_cost"),
        F.when(F.col("event_type") != "click", F.lit(2.0)).alias("analysis_cost"),
    )
    return S.job_durations(rows)


_EXAM = """g AS (SELECT l_orderkey AS submission_id, o_orderpriority AS class_id, CASE o_orderstatus WHEN 'P' THEN 'Punjab_Matric' WHEN 'O' THEN 'FBISE' ELSE 'Cambridge' END AS board, 50 AS mx, l_quantity AS aw
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    t AS (SELECT submission_id, class_id, board, CAST(sum(mx) AS DOUBLE) AS total_marks, sum(aw) AS marks_awarded, CAST(floor(sum(aw) / sum(mx) * 100 + 0.5) AS BIGINT) AS percentage FROM g GROUP BY ALL),
    r AS (SELECT *, CASE board WHEN 'FBISE' THEN CASE WHEN percentage >= 90 THEN 'A+' WHEN percentage >= 80 THEN 'A' WHEN percentage >= 70 THEN 'B' WHEN percentage >= 60 THEN 'C' WHEN percentage >= 50 THEN 'D' WHEN percentage >= 40 THEN 'E' ELSE 'F' END
      WHEN 'Punjab_Matric' THEN CASE WHEN percentage >= 80 THEN 'A-1' WHEN percentage >= 70 THEN 'A' WHEN percentage >= 60 THEN 'B' WHEN percentage >= 50 THEN 'C' WHEN percentage >= 40 THEN 'D' WHEN percentage >= 33 THEN 'E' ELSE 'Fail' END
      ELSE CASE WHEN percentage >= 90 THEN 'A*' WHEN percentage >= 80 THEN 'A' WHEN percentage >= 70 THEN 'B' WHEN percentage >= 60 THEN 'C' WHEN percentage >= 50 THEN 'D' WHEN percentage >= 40 THEN 'E' WHEN percentage >= 30 THEN 'F' WHEN percentage >= 20 THEN 'G' ELSE 'U' END END AS grade FROM t)"""


def _exam(p):
    lines = p.table("lineitem").join(p.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return S.exam_totals(
        lines.select(
            F.col("l_orderkey").alias("submission_id"),
            F.col("o_orderpriority").alias("class_id"),
            F.expr("CASE o_orderstatus WHEN 'P' THEN 'Punjab_Matric' WHEN 'O' THEN 'FBISE' ELSE 'Cambridge' END").alias("board"),
            F.lit(50.0).alias("max_marks"),
            F.col("l_quantity").alias("awarded_marks"),
        )
    )


@query("A42_exam_totals", f"WITH {_EXAM} SELECT submission_id, class_id, board, total_marks, marks_awarded, percentage, grade, grade NOT IN ('F', 'Fail', 'U') AS passed FROM r")
def a42(spark, folder):
    return _exam(Programme(spark, folder)).drop("gpa", "division")


@query(
    "A42_class_summary",
    f"WITH {_EXAM} SELECT class_id, count(*) AS students, CAST(floor(avg(percentage) + 0.5) AS BIGINT) AS average_percentage, max(percentage) AS highest_score, min(percentage) AS lowest_score FROM r GROUP BY class_id",
)
def a42_class(spark, folder):
    return S.class_summary(_exam(Programme(spark, folder)))


@query("A42_grade_distribution", f"WITH {_EXAM} SELECT class_id, grade, count(*) AS students FROM r GROUP BY class_id, grade")
def a42_grades(spark, folder):
    return S.grade_distribution(_exam(Programme(spark, folder)))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), lambda w: length(w) > 3))"


@query(
    "A42_keyword_marks",
    f"""WITH a AS (SELECT d.doc_id, {_WORDS.format(t='d.text')} AS want, {_WORDS.format(t='e.text')} AS have FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1),
    r AS (SELECT doc_id, CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) ELSE 0.0 END AS ratio FROM a)
    SELECT doc_id, round(ratio, 9) AS match_ratio, CAST(floor(ratio * 20 + 0.5) AS BIGINT) AS marks_awarded FROM r""",
)
def a42_keywords(spark, folder):
    docs = Programme(spark, folder).table("documents")
    given = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("student_answer"))
    pairs = docs.select("doc_id", F.col("text").alias("correct_answer"), F.lit(20).alias("marks")).join(given, "doc_id")
    return S.keyword_marks(pairs).select("doc_id", F.round("match_ratio", 9).alias("match_ratio"), "marks_awarded")


# Scalar functions ------------------------------------------------------------------------------------


@query(
    "F2_maths",
    over_programme("""
    SELECT id, floor(value * 10 - 500.5 + 0.5) AS half_up_, round_even(k / 8.0, 0) AS half_even_, CASE WHEN k = 0 THEN 0.0 ELSE round(floor(value) / k * 60, 2) END AS wcpm,
      CASE WHEN k = 0 THEN 0.0 ELSE round(floor(value) / k * 100, 2) END AS attendance FROM ev"""),
)
def f2(spark, folder):
    ev = Programme(spark, folder).ev
    return ev.select(
        "id",
        maths.half_up(F.col("value") * 10 - 500.5).cast("double").alias("half_up_"),
        maths.half_even(F.col("k") / 8.0).alias("half_even_"),
        maths.wcpm(F.floor("value"), F.col("k")).alias("wcpm"),
        maths.attendance_pct(F.floor("value"), F.col("k")).alias("attendance"),
    )


@query(
    "F3_bands",
    over_programme("""
    SELECT id, CASE WHEN k >= 80 THEN 'mastered' WHEN k >= 60 THEN 'developing' ELSE 'needs_practice' END AS mastery,
      CASE WHEN k >= 80 THEN 'excellent' WHEN k >= 60 THEN 'proficient' WHEN k >= 40 THEN 'developing' ELSE 'emerging' END AS performance,
      CASE WHEN k >= 85 THEN 'bora_sana' WHEN k >= 70 THEN 'mwenye_uwezo' WHEN k >= 55 THEN 'inakua' ELSE 'inajitokeza' END AS swahili,
      CASE WHEN value < 1 THEN 'mixed' WHEN k >= 80 AND floor(value / 2) / floor(value) >= 0.7 THEN 'strong' WHEN k < 60 OR floor(value / 2) / floor(value) < 0.3 THEN 'weak' ELSE 'mixed' END AS class_band FROM ev"""),
)
def f3(spark, folder):
    ev = Programme(spark, folder).ev
    k = F.col("k")
    return ev.select(
        "id",
        bands.mastery(k).alias("mastery"),
        bands.performance(k).alias("performance"),
        bands.performance_swahili(k).alias("swahili"),
        bands.class_band(k, F.floor(F.col("value") / 2), F.floor("value")).alias("class_band"),
    )


@query(
    "F4_climate",
    f"""WITH {ANSWERS}, c AS (SELECT session_id, count(*) FILTER (WHERE is_correct) AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM answers GROUP BY session_id)
    SELECT session_id, CASE WHEN n > 3 THEN 'CONCERNING' WHEN q / (greatest(a * 10, 1) / 30.0) >= 5 AND n <= 1 THEN 'POSITIVE' WHEN q / (greatest(a * 10, 1) / 30.0) >= 3 OR n <= 2 THEN 'GOOD' ELSE 'NEEDS_IMPROVEMENT' END AS emotional,
      CASE WHEN a + n + q >= 10 THEN 'EXCELLENT' WHEN a + n + q >= 5 THEN 'GOOD' WHEN a + n + q >= 2 THEN 'ROOM_TO_GROW' ELSE 'NEEDS_IMPROVEMENT' END AS instructional,
      CASE WHEN n = 0 AND a > 0 THEN 'WELL_ORGANIZED' WHEN n <= 3 THEN 'GOOD' ELSE 'NEEDS_ATTENTION' END AS organization,
      CASE WHEN q < 20 THEN 'NOT_ADDRESSED' WHEN n = 1 AND a >= 2 THEN 'ACHIEVED' WHEN n = 1 THEN 'LIKELY_ACHIEVED' WHEN n = 2 THEN 'NEEDS_EVIDENCE' WHEN n = 3 OR a = 0 THEN 'NOT_ASSESSED' ELSE 'UNKNOWN' END AS objective FROM c""",
)
def f4(spark, folder):
    counts = Programme(spark, folder).picks.groupBy("session_id").agg(
        F.count_if("is_correct").alias("a"),
        F.count_if(F.col("l_returnflag") == "R").alias("n"),
        F.sum("l_quantity").cast("bigint").alias("q"),
    )
    a, n, q = F.col("a"), F.col("n"), F.col("q")
    level = F.when(n == 1, "HIGH").when(n == 2, "medium").when(n == 3, "low")
    return counts.select(
        "session_id",
        bands.emotional_support(q, n, a * 10).alias("emotional"),
        bands.instructional_support(a, n, q).alias("instructional"),
        bands.classroom_organization(a, n).alias("organization"),
        bands.objective_status(level, a, q >= 20).alias("objective"),
    )


_RAW = """concat(CASE WHEN p_size < 10 THEN 'M' WHEN p_size < 20 THEN 'Eng' ELSE lower(left(p_type, 5)) END, '-', lpad(CAST(p_size AS VARCHAR(3)), 2, '0'), '-', left(p_name, 2), '-', lpad(CAST(length(p_name) AS VARCHAR(3)), 2, '0'),
  CASE WHEN p_retailprice < 950 THEN 'b' WHEN p_retailprice < 1000 THEN ' [DERIVED]' ELSE '' END)"""


@query(
    "F5_parse_code",
    f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw, lpad(CAST(length(p_type) AS VARCHAR), 2, '0') AS book_grade FROM part),
    m AS (SELECT *, regexp_extract(raw, '^([A-Za-z]{{1,4}}-[0-9]{{2}}-[A-Za-z]{{2,4}}-[0-9]{{2}}[a-z]?)', 1) AS code FROM r)
    SELECT p_partkey, CASE WHEN code = '' THEN raw ELSE code END AS code, CASE WHEN code = '' THEN '' ELSE split_part(code, '-', 1) END AS subject,
      CASE WHEN code = '' THEN '' ELSE split_part(code, '-', 2) END AS grade, CASE WHEN code = '' THEN '' ELSE split_part(code, '-', 3) END AS strand,
      CASE WHEN code = '' THEN '' WHEN contains(raw, '[DERIVED]') THEN 'DERIVED' ELSE '' END AS fused_note,
      concat_ws(',', CASE WHEN code = '' THEN 'MALFORMED' END, CASE WHEN code <> '' AND contains(raw, '[DERIVED]') THEN 'FUSED_ANNOTATION' END,
        CASE WHEN code <> '' AND split_part(code, '-', 2) <> book_grade THEN 'GRADE_MISMATCH' END) AS issues FROM m""",
)
def f5(spark, folder):
    part = Programme(spark, folder).table("part").select(
        "p_partkey", F.expr(_RAW.replace("VARCHAR(3)", "STRING")).alias("raw"), F.lpad(F.length("p_type").cast("string"), 2, "0").alias("g")
    )
    parsed = part.withColumn("c", codes.parse_code(F.col("raw")))
    return parsed.select(
        "p_partkey", "c.code", "c.subject", "c.grade", "c.strand", "c.fused_note",
        F.concat_ws(",", codes.validate_code(F.col("raw"), F.col("g"))).alias("issues"),
    )


@query(
    "F7_normalize_status",
    f"""WITH t AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\s+', ' ', 'g') AS l FROM conversations)
    SELECT conv_id, turn, CASE WHEN l = '' THEN 'unknown' WHEN list_has_any([contains(l, w) OR contains(replace(l, ' ', ''), replace(w, ' ', '')) FOR w IN [{', '.join(f"'{w}'" for w in names.ABSENT_WORDS)}]], [true]) THEN 'absent'
      WHEN list_has_any([contains(l, w) OR contains(replace(l, ' ', ''), w) FOR w IN [{', '.join(f"'{w}'" for w in names.PRESENT_WORDS)}]], [true]) THEN 'present' ELSE 'unknown' END AS status FROM t""",
)
def f7(spark, folder):
    return Programme(spark, folder).table("conversations").select("conv_id", "turn", names.normalize_status(F.col("text")).alias("status"))


@query(
    "F8_tokenize",
    """SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s\\x{0600}-\\x{06FF}]', '', 'g'), '\\s+'), lambda w: w <> ''), ' ') AS tokens FROM documents""",
)
def f8(spark, folder):
    return Programme(spark, folder).table("documents").select("doc_id", F.array_join(text.tokenize(F.col("text")), " ").alias("tokens"))


_CLEAN = "text"
for _pattern in (
    "\\[[0-9]{2}:[0-9]{2}\\]",
    "(?i)\\bTeacher\\b\\s*\\([A-Z]{2}\\)\\s*:",
    "(?i)\\bStudent\\b\\s*\\([A-Z]{2}\\)\\s*:",
    "(?i)\\b(EN|UR|AR|ES)\\b",
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '', 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("F8_clean_transcript", f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def f8_clean(spark, folder):
    return Programme(spark, folder).table("documents").select("doc_id", text.clean_transcript(F.col("text")).alias("clean"))


_LINE = "concat(CASE WHEN turn < 3 THEN '[0' || turn || ':1' || turn || '] ' ELSE '' END, CASE role WHEN 'user' THEN 'Student 2 (EN): ' WHEN 'assistant' THEN 'teacher  (UR):' ELSE '' END, text)"


@query(
    "F8_parse_lines",
    f"""WITH l AS (SELECT conv_id, turn, unnest(string_split({_LINE}, chr(10))) AS line, generate_subscripts(string_split({_LINE}, chr(10)), 1) - 1 AS line_no FROM conversations),
    m AS (SELECT *, regexp_matches(line, '(?i)^\\[([0-9]{{2}}:[0-9]{{2}})\\]\\s*(Teacher|Student\\s*[0-9]*)\\s*\\((\\w+)\\):\\s*(.*)$') AS ok FROM l WHERE trim(line) <> '')
    SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, CASE WHEN ok THEN substring(line, 2, 5) ELSE '--:--' END AS spoken_at, CASE WHEN ok THEN CASE WHEN contains(line, 'Student 2') THEN 'Student 2' ELSE 'teacher' END ELSE 'Unknown' END AS speaker,
      CASE WHEN ok AND NOT contains(line, 'Student 2') THEN 'teacher' ELSE 'student' END AS speaker_type, trim(CASE WHEN ok THEN substring(line, position('):' IN line) + 2) ELSE line END) AS line_text FROM m""",
)
def f8_lines(spark, folder):
    rows = Programme(spark, folder).table("conversations").select("conv_id", "turn", F.expr(_LINE).alias("text"))
    return text.parse_lines(rows)


@query(
    "F9_detect_language",
    """WITH t AS (SELECT doc_id, lang, length(regexp_replace(text, '\\s', '', 'g')) AS n, length(regexp_replace(text, '[^áéíóúñ¿¡ÁÉÍÓÚÑ]', '', 'g')) AS s, length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g')) AS a,
      regexp_matches(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]') AS arabic FROM documents)
    SELECT doc_id, CASE WHEN arabic THEN 'arabic' ELSE 'latin' END AS script, CASE WHEN n = 0 THEN 'en' WHEN s / n > 0.01 THEN 'es' WHEN a / n > 0.5 THEN 'ur' ELSE 'en' END AS language FROM t""",
)
def f9(spark, folder):
    body = F.col("text")
    return Programme(spark, folder).table("documents").select(
        "doc_id", text.script_of(body).alias("script"), text.detect_language(body).alias("language")
    )


# Invented phrases of the test texts stand in for the feature phrases.
_PHRASES = {"alpha": {"high": ["the on", "the and", "on the"], "medium": ["is the", "and on"]}, "beta": {"high": ["le la", "ion le"], "medium": ["la le", "le ai"]}}


def _score_sql(lists):
    parts = [f"CASE WHEN contains(l, '{w}') THEN {v} ELSE 0 END" for k, v in (("high", 5), ("medium", 3)) for w in lists[k]]
    return f"({' + '.join(parts)}) / 10"


@query(
    "F10_feature_scores",
    f"""WITH t AS (SELECT doc_id, lower(text) AS l FROM documents), s AS (SELECT doc_id, {_score_sql(_PHRASES['alpha'])} AS alpha, {_score_sql(_PHRASES['beta'])} AS beta FROM t)
    SELECT doc_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, CASE WHEN greatest(alpha, beta) >= 0.5 THEN CASE WHEN alpha >= beta THEN 'alpha' ELSE 'beta' END END AS best FROM s""",
)
def f10(spark, folder):
    docs = Programme(spark, folder).table("documents").select("doc_id", text.feature_scores(F.col("text"), _PHRASES).alias("s"))
    best = text.best_feature(F.col("s"), list(_PHRASES))
    return docs.select("doc_id", F.round("s.alpha", 6).alias("alpha"), F.round("s.beta", 6).alias("beta"), best.alias("best"))


_ROSTER = "concat(c_custkey, '. ', c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN ' s/o Parent ' || c_nationkey WHEN c_mktsegment = 'FURNITURE' THEN ', Father, Jr ' WHEN c_mktsegment = 'MACHINERY' THEN ' +92 300-12345' || lpad(CAST(c_nationkey AS VARCHAR(3)), 2, '0') || ' ;' ELSE '' END, chr(10), '- ', c_mktsegment, chr(10), '  ', chr(10), '0300 1234567')"


@query(
    "F11_parse_roster",
    """WITH f AS (SELECT c_custkey, 0 AS line_no, c_name AS student_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Parent ' || c_nationkey WHEN 'FURNITURE' THEN 'Father, Jr' END AS father_name,
      CASE c_mktsegment WHEN 'MACHINERY' THEN '+9230012345' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS parent_phone FROM customer)
    SELECT * FROM f UNION ALL SELECT c_custkey, 1, c_mktsegment, NULL, NULL FROM customer""",
)
def f11(spark, folder):
    rows = Programme(spark, folder).table("customer").select("c_custkey", F.expr(_ROSTER).alias("text"))
    return names.parse_roster(rows)


_PHONE = "CASE c_mktsegment WHEN 'BUILDING' THEN '0' || lpad(CAST(c_custkey AS VARCHAR(12)), 9, '3') WHEN 'FURNITURE' THEN '+9' || c_custkey WHEN 'MACHINERY' THEN '(92) 300-' || lpad(CAST(c_custkey AS VARCHAR(12)), 7, '1') WHEN 'HOUSEHOLD' THEN c_name ELSE '' END"


@query(
    "F12_normalize_phone",
    f"""WITH r AS (SELECT c_custkey, {_PHONE} AS raw FROM customer), p AS (SELECT *, regexp_replace(raw, '[\\s()-]', '', 'g') AS c FROM r),
    q AS (SELECT *, CASE WHEN regexp_matches(c, '^0[0-9]{{6,}}$') THEN '+44' || substring(c, 2) WHEN regexp_matches(c, '^[0-9]{{7,15}}$') THEN '+' || c ELSE c END AS ph FROM p),
    z AS (SELECT *, CASE WHEN raw = '' THEN 'required' WHEN regexp_matches(c, '[a-zA-Z]') THEN 'letters' WHEN NOT regexp_matches(ph, '^\\+[1-9][0-9]{{6,14}}$') THEN
        CASE WHEN length(regexp_replace(ph, '[^0-9]', '', 'g')) < 7 THEN 'too_short' WHEN length(regexp_replace(ph, '[^0-9]', '', 'g')) > 15 THEN 'too_long' ELSE 'invalid' END
        WHEN regexp_matches(ph, '^\\+(53|98|850|963|7978)') THEN 'blocked' END AS reason FROM q)
    SELECT c_custkey, reason IS NULL AS valid, CASE WHEN reason IS NULL THEN ph END AS normalized, reason FROM z""",
)
def f12(spark, folder):
    rows = Programme(spark, folder).table("customer").select("c_custkey", F.expr(_PHONE).alias("raw"))
    return rows.select("c_custkey", names.normalize_phone(F.col("raw"), "+44").alias("p")).select("c_custkey", "p.*")


@query(
    "F13_json_pick",
    """SELECT event_id, CASE event_type WHEN 'click' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) WHEN 'view' THEN 0.0 WHEN 'error' THEN NULL ELSE value END AS score,
      CAST(1 + CASE WHEN value > 50 THEN 1 ELSE 0 END AS INTEGER) AS correct, CASE WHEN event_type = 'click' THEN 'cat' WHEN event_type = 'view' THEN 'dog:hard' ELSE '' END AS issues FROM events""",
)
def f13(spark, folder):
    ev = Programme(spark, folder).table("events")
    k = F.get_json_object("props", "$.k")
    scores = F.struct(F.when(F.col("event_type") == "click", k).when(F.col("event_type") == "view", " ").when(F.col("event_type") == "error", "bad").alias("overall_percentage"), F.col("value").alias("percentage"))
    answers = F.array(F.struct(F.lit(True).alias("correct")), F.struct((F.col("value") > 50).alias("correct")), F.struct(F.lit(False).alias("correct")))
    words = F.array(
        F.struct(F.lit("cat").alias("word"), F.lit("Mispronunciation").alias("errorType")), F.struct(F.lit("sat").alias("word"), F.lit("None").alias("errorType"))
    )
    listed = F.array(F.struct(F.lit("dog").alias("word"), F.lit("hard").alias("description")))
    said = F.to_json(F.struct(F.when(F.col("event_type") == "click", words).alias("words"), F.when(F.col("event_type") == "view", listed).alias("mispronounced_words")))
    rows = ev.select("event_id", "event_type", F.to_json(F.struct(scores.alias("scores"))).alias("j"), answers.alias("a"), said.alias("w"))
    lang = F.when(F.col("event_type") == "click", "en").otherwise("ur")
    issues = F.transform(
        text.mispronounced(F.col("w"), lang),
        lambda x: F.concat(x["word"], F.when(x["issue"] != "Mispronunciation detected", F.concat(F.lit(":"), x["issue"])).otherwise("")),
    )
    return rows.select(
        "event_id", text.json_pick(F.col("j"), *text.SCORE_PATHS).alias("score"), text.count_correct(F.col("a")).alias("correct"), F.array_join(issues, ",").alias("issues")
    )


@query(
    "F14_paragraph_chunks",
    """WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
    r AS (SELECT doc_id, t, list_reduce(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {'done': CAST([] AS VARCHAR[]), 'cur': p}), lambda a, b: CASE WHEN length(a.cur) + length(b.cur) > 400 AND length(a.cur) > 0
        THEN {'done': list_append(a.done, trim(a.cur, E' \\n\\t\\r')), 'cur': b.cur} ELSE {'done': a.done, 'cur': CASE WHEN a.cur = '' THEN b.cur ELSE a.cur || chr(10) || chr(10) || b.cur END} END) AS s FROM d),
    c AS (SELECT doc_id, CASE WHEN length(t) <= 400 THEN [t] WHEN s.cur <> '' THEN list_append(s.done, trim(s.cur, E' \\n\\t\\r')) ELSE s.done END AS chunks FROM r)
    SELECT doc_id, CAST(len(chunks) AS INTEGER) AS n, array_to_string(chunks, '|') AS chunks FROM c""",
)
def f14(spark, folder):
    docs = Programme(spark, folder).table("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    chunks = docs.select("doc_id", text.paragraph_chunks(F.col("t"), 400).alias("c"))
    return chunks.select("doc_id", F.size("c").alias("n"), F.array_join("c", "|").alias("chunks"))


_SAMPLE = ["A", "b", "ا", "q", "W", "?"]


def _letters_sql():
    cells = []
    for letter in _SAMPLE:
        wanted = letters.spoken_names(letter) or [""]
        cells.append("(" + " OR ".join(f"contains(l, '{w}')" for w in wanted) + ")")
    return " + ".join(f"CAST({c} AS INTEGER)" for c in cells)


@query(
    "F15_letters_correct",
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(regexp_replace(lower(text), '[،؟۔,.!?:;''"()\\[\\]{{}}]', '', 'g'), '\\s+', ' ', 'g')) AS l FROM conversations)
    SELECT id, {len(_SAMPLE)} AS total, {_letters_sql()} AS matched, CAST(floor(({_letters_sql()}) / {len(_SAMPLE)} * 100 + 0.5) AS INTEGER) AS accuracy FROM t""",
)
def f15(spark, folder):
    rows = Programme(spark, folder).table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array(*[F.lit(x) for x in _SAMPLE]).alias("letters"), F.col("text").alias("transcript")
    )
    return letters.letters_correct(rows)


@query(
    "F6_dice",
    """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(concat(left(p_name, 4), p_type)) AS b FROM part),
    g AS (SELECT *, list_distinct([substring(a, i, 2) FOR i IN generate_series(1, length(a) - 1)]) AS ga, list_distinct([substring(b, i, 2) FOR i IN generate_series(1, length(b) - 1)]) AS gb FROM p)
    SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 WHEN contains(b, a) THEN 0.7 + length(a) / length(b) * 0.3 WHEN contains(a, b) THEN 0.7 + length(b) / length(a) * 0.3
      ELSE 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) END, 6) AS score FROM g""",
)
def f6(spark, folder):
    part = Programme(spark, folder).table("part")
    other = F.concat(F.left("p_name", F.lit(4)), F.col("p_type"))
    return part.select("p_partkey", F.round(names.dice(F.col("p_name"), other), 6).alias("score"))
