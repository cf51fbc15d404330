"""Registered queries for A1 to A16, A38 and A43."""

from pyspark.sql import functions as F

from chalkline.operators import filters as P
from chalkline.operators import joins as J
from chalkline.operators import sets as U
from chalkline.operators import stats as A
from chalkline.plans.registry import query
from chalkline.plans.standins import AS_OF, Programme, over_programme

NOW = f"TIMESTAMP '{AS_OF}'"


def tables(spark, folder):
    p = Programme(spark, folder)
    sessions = p.chat_sessions.withColumn("last_activity_at", F.col("ended_at"))
    return p, A.Tables(p.users, p.chat, sessions, p.lesson_plans, p.coaching, p.reading, p.videos)


_USED = """SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') + count(DISTINCT user_id) FILTER (WHERE event_type = 'signup')
  + count(DISTINCT user_id) FILTER (WHERE event_type = 'error') + count(DISTINCT user_id) FILTER (WHERE event_type = 'view') FROM ev"""
_ANY = "SELECT count(DISTINCT user_id) FROM ev WHERE event_type IN ('purchase', 'signup', 'error')"
_COMMON = f"""
  (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM chat) AS total_messages,
  (SELECT count(*) FROM chat WHERE role = 'user' AND message_type = 'voice') AS voice_notes_received,
  (SELECT count(DISTINCT user_id) FROM chat WHERE role = 'user' AND created_at >= {NOW} - INTERVAL 1 DAY) AS daily_active_users,
  (SELECT count(DISTINCT user_id) FROM chat WHERE role = 'user' AND created_at >= {NOW} - INTERVAL 7 DAY) AS weekly_active_users,
  (SELECT count(*) FROM chat_sessions) AS total_sessions,
  (SELECT count(*) FROM chat_sessions WHERE started_at >= date_trunc('day', {NOW})) AS sessions_today,
  (SELECT count(*) FROM chat_sessions WHERE started_at >= {NOW} - INTERVAL 7 DAY) AS sessions_this_week,
  (SELECT round(avg(epoch_us(ended_at) - epoch_us(started_at)) / 60000000, 1) FROM chat_sessions) AS avg_session_length,
  (SELECT round(avg(message_count), 1) FROM chat_sessions) AS avg_messages_per_session,
  (SELECT count(*) FROM coaching WHERE status = 'completed') AS total_coaching_sessions,
  (SELECT count(*) FROM videos WHERE status = 'completed') AS total_videos_generated,
  (SELECT count(*) FROM reading WHERE status = 'completed') AS total_reading_assessments"""


@query(
    "A1_dashboard_stats_snapshot",
    over_programme(f"""
    SELECT {_COMMON}, (SELECT count(*) FROM lesson_plans) AS total_lesson_plans,
      (SELECT count(*) FROM lesson_plans WHERE gamma_url IS NOT NULL) AS total_presentations,
      (SELECT round(100.0 * count(registration_completed_at) / count(*), 1) FROM users) AS registration_rate,
      round(100.0 * ({_ANY}) / (SELECT count(*) FROM users), 1) AS feature_discovery_rate"""),
)
def a1(spark, folder):
    return A.dashboard_stats(tables(spark, folder)[1], AS_OF, "snapshot")


@query(
    "A1_dashboard_stats_live",
    over_programme(f"""
    SELECT {_COMMON}, (SELECT count(*) FROM lesson_plans WHERE type = 'lesson_plan') AS total_lesson_plans,
      (SELECT count(*) FROM lesson_plans WHERE type = 'presentation') AS total_presentations,
      (SELECT round(100.0 * count(*) FILTER (WHERE registration_completed) / count(*), 1) FROM users) AS registration_rate,
      round(100.0 * ({_USED}) / (4 * (SELECT count(*) FROM users)), 1) AS feature_discovery_rate"""),
)
def a1_live(spark, folder):
    return A.dashboard_stats(tables(spark, folder)[1], AS_OF, "live")


@query(
    "A2_active_users",
    over_programme(f"SELECT count(DISTINCT user_id) AS active_users FROM chat WHERE role = 'user' AND created_at >= {NOW} - INTERVAL 7 DAY"),
)
def a2(spark, folder):
    return A.active_users(Programme(spark, folder).chat, AS_OF, 7)


@query(
    "A3_status_counts",
    over_programme("""
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
      count(*) FILTER (WHERE status IN ('processing', 'queued')) AS processing, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
      CAST(floor(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*) + 0.5) AS BIGINT) AS success_rate FROM videos"""),
)
def a3(spark, folder):
    return A.status_counts(Programme(spark, folder).videos)


@query(
    "A3_coaching_status",
    over_programme("""
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
      count(*) FILTER (WHERE status NOT IN ('completed', 'failed', 'cancelled')) AS in_progress FROM coaching"""),
)
def a3_coaching(spark, folder):
    return A.coaching_status_counts(Programme(spark, folder).coaching)


@query(
    "A3_scope_stats",
    """SELECT count(*) AS total, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS scope_all, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS scope_country,
      count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS scope_school, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS scope_phone_list,
      count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS scope_combined FROM customer""",
)
def a3_scopes(spark, folder):
    kinds = F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'all' WHEN 'AUTOMOBILE' THEN 'country' WHEN 'FURNITURE' THEN 'school' "
        "WHEN 'HOUSEHOLD' THEN 'phone_list' WHEN 'MACHINERY' THEN 'combined' END"
    )
    return A.scope_stats(Programme(spark, folder).table("customer").select(kinds.alias("scope_type")))


_MSG = "CASE WHEN l_returnflag = 'A' THEN 'read' WHEN l_returnflag = 'R' THEN 'delivered' WHEN l_linestatus = 'F' THEN 'failed' WHEN l_quantity < 25 THEN 'sent' ELSE 'pending' END"


@query(
    "A3_delivery_rates",
    f"""WITH m AS (SELECT l_suppkey AS broadcast_id, {_MSG} AS status, CASE WHEN l_discount > 0.05 THEN l_shipdate END AS replied_at FROM lineitem),
    c AS (SELECT broadcast_id, count(*) FILTER (WHERE status <> 'pending') AS sent, count(*) FILTER (WHERE status IN ('delivered', 'read')) AS delivered,
      count(*) FILTER (WHERE status = 'read') AS read, count(replied_at) AS replied, count(*) FILTER (WHERE status = 'failed') AS failed
      FROM m GROUP BY broadcast_id)
    SELECT *, round(delivered / greatest(sent, 1) * 100, 1) AS delivery_rate, round(read / greatest(sent, 1) * 100, 1) AS read_rate,
      round(replied / greatest(sent, 1) * 100, 1) AS reply_rate, round(failed / greatest(sent, 1) * 100, 1) AS failure_rate FROM c""",
)
def a3_delivery(spark, folder):
    rows = Programme(spark, folder).table("lineitem").select(
        F.col("l_suppkey").alias("broadcast_id"),
        F.expr(_MSG).alias("status"),
        F.when(F.col("l_discount") > 0.05, F.col("l_shipdate")).alias("replied_at"),
    )
    return A.delivery_rates(rows)


@query(
    "A4_daily_counts",
    over_programme(f"SELECT CAST(started_at AS DATE) AS date, count(*) AS count FROM chat_sessions WHERE started_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1"),
)
def a4(spark, folder):
    return A.daily_counts(Programme(spark, folder).chat_sessions, AS_OF, 7, "started_at")


@query(
    "A4_daily_status",
    over_programme(f"""
    SELECT CAST(created_at AS DATE) AS date, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
      count(*) FILTER (WHERE status = 'failed') AS failed FROM videos WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1"""),
)
def a4_status(spark, folder):
    return A.daily_status_counts(Programme(spark, folder).videos, AS_OF, 30)


@query(
    "A5_hourly_histogram",
    over_programme("""
    SELECT CAST(h AS INTEGER) AS hour, count(user_id) AS count FROM generate_series(0, 23) AS t(h)
    LEFT JOIN chat_sessions ON hour(started_at) = h GROUP BY h"""),
)
def a5(spark, folder):
    return A.hourly_histogram(Programme(spark, folder).chat_sessions)


@query(
    "A6_type_breakdown",
    over_programme("""
    SELECT CASE coalesce(session_type, 'general') WHEN 'lesson_plan' THEN 'Lesson Plan' WHEN 'presentation' THEN 'Presentation'
      WHEN 'general' THEN 'General Chat' ELSE 'Audio Coaching' END AS type, count(*) AS count FROM chat_sessions GROUP BY 1
    UNION ALL SELECT 'Coaching Session', count(*) FROM coaching
    UNION ALL SELECT 'AI Video Generation', count(*) FROM videos WHERE status = 'completed'"""),
)
def a6(spark, folder):
    p = Programme(spark, folder)
    return A.type_breakdown(p.chat_sessions, p.coaching, p.videos)


@query(
    "A7_session_averages",
    over_programme("""
    SELECT round(avg(epoch_us(ended_at) - epoch_us(started_at)) / 60000000, 1) AS avg_session_length, round(avg(message_count), 1) AS avg_messages
    FROM chat_sessions"""),
)
def a7(spark, folder):
    return A.session_averages(Programme(spark, folder).chat_sessions)


_CUR = "BETWEEN TIMESTAMP '2024-01-16 00:00:00' AND TIMESTAMP '2024-01-22 23:59:59.999'"
_PREV = "BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 23:59:59.999'"


def _period_sql(span):
    users = f"FROM users WHERE created_at {span}"
    tried = f"""SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM ev WHERE event_type <> 'click')
      WHERE user_id IN (SELECT id {users})"""
    return f"""SELECT * FROM (VALUES
      ('total_users', (SELECT count(*) {users})),
      ('total_messages', (SELECT count(*) FROM chat WHERE created_at {span})),
      ('voice_notes_received', (SELECT count(*) FROM chat WHERE role = 'user' AND message_type = 'voice' AND created_at {span})),
      ('total_sessions', (SELECT count(*) FROM chat_sessions WHERE started_at {span})),
      ('sessions_today', (SELECT count(*) FROM chat_sessions WHERE started_at {span})),
      ('avg_session_length', (SELECT CAST(coalesce(floor(avg(epoch_us(ended_at) - epoch_us(started_at)) / 60000000 + 0.5), 0) AS BIGINT) FROM chat_sessions WHERE started_at {span})),
      ('registration_rate', (SELECT CAST(coalesce(floor(100.0 * count(*) FILTER (WHERE registration_completed) / nullif(count(*), 0) + 0.5), 0) AS BIGINT) {users})),
      ('feature_discovery_rate', CAST(coalesce(floor(100.0 * ({tried}) / nullif(4 * (SELECT count(*) {users}), 0) + 0.5), 0) AS BIGINT)),
      ('total_lesson_plans', (SELECT count(*) FROM lesson_plans WHERE type = 'lesson_plan' AND created_at {span})),
      ('total_presentations', (SELECT count(*) FROM lesson_plans WHERE type = 'presentation' AND created_at {span})),
      ('total_coaching_sessions', (SELECT count(*) FROM coaching WHERE status = 'completed' AND created_at {span})),
      ('total_videos_generated', (SELECT count(*) FROM videos WHERE status = 'completed' AND created_at {span})),
      ('total_reading_assessments', (SELECT count(*) FROM reading WHERE status = 'completed' AND created_at {span})),
      ('active_users', (SELECT count(DISTINCT user_id) FROM chat WHERE role = 'user' AND created_at {span}))) AS t(metric, v)"""


@query(
    "A8_period_compare",
    over_programme(f"""
    SELECT c.metric, c.v AS current, p.v AS previous, CAST(CASE WHEN c.metric IN ('registration_rate', 'feature_discovery_rate') THEN c.v - p.v
      WHEN p.v = 0 THEN CASE WHEN c.v > 0 THEN 100 ELSE 0 END ELSE floor((c.v - p.v) / p.v * 100 + 0.5) END AS BIGINT) AS change
    FROM ({_period_sql(_CUR)}) c JOIN ({_period_sql(_PREV)}) p ON p.metric = c.metric"""),
)
def a8(spark, folder):
    return A.period_compare(tables(spark, folder)[1], *A.previous_period("2024-01-16", "2024-01-22"))


@query(
    "A9_registration_rate",
    over_programme("SELECT round(100.0 * count(*) FILTER (WHERE registration_completed) / count(*), 1) AS registration_rate FROM users"),
)
def a9(spark, folder):
    return A.registration_rate(Programme(spark, folder).users)


@query(
    "A10_feature_discovery_live",
    over_programme(f"SELECT round(100.0 * ({_USED}) / (4 * (SELECT count(*) FROM users)), 1) AS feature_discovery_rate"),
)
def a10(spark, folder):
    return A.feature_discovery(tables(spark, folder)[1], "live")


@query(
    "A10_feature_discovery_snapshot",
    over_programme(f"SELECT round(100.0 * ({_ANY}) / (SELECT count(*) FROM users), 1) AS feature_discovery_rate"),
)
def a10_snapshot(spark, folder):
    return A.feature_discovery(tables(spark, folder)[1], "snapshot")


_SPAN = "BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20'"


@query(
    "A11_funnel",
    over_programme(f"""
    WITH f AS (SELECT (SELECT count(*) FROM videos WHERE created_at {_SPAN}) AS website_visits, (SELECT count(*) FROM chat WHERE created_at {_SPAN}) AS cta_clicks,
      (SELECT count(*) FROM coaching WHERE created_at {_SPAN}) AS chat_starts,
      (SELECT count(*) FROM users WHERE registration_completed AND registration_completed_at {_SPAN}) AS registrations)
    SELECT *, round(100.0 * cta_clicks / website_visits, 2) AS visit_to_cta, round(100.0 * chat_starts / cta_clicks, 2) AS cta_to_chat,
      round(100.0 * registrations / chat_starts, 2) AS chat_to_registration, round(100.0 * registrations / website_visits, 2) AS overall,
      website_visits - cta_clicks AS lost_after_visit, cta_clicks - chat_starts AS lost_after_cta, chat_starts - registrations AS lost_after_chat FROM f"""),
)
def a11(spark, folder):
    p = Programme(spark, folder)
    return A.funnel(p.videos, p.chat, p.coaching, p.users, "2024-01-01", "2024-01-20")


@query(
    "A12_traffic_sources",
    over_programme("SELECT source, count(*) AS count FROM users WHERE source IS NOT NULL AND created_at >= TIMESTAMP '2024-01-01' GROUP BY source"),
)
def a12(spark, folder):
    return A.traffic_sources(Programme(spark, folder).users, "2024-01-01")


# Retention: a customer starts with the first order; the order priority is the kind of activity.
RETENTION_AS_OF = "1995-06-01"
_START = "WITH people AS (SELECT o_custkey AS id, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey)"
_ACTIVE = """act AS (SELECT o_custkey AS user_id, o_orderdate AS happened FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')
   OR o_orderpriority = '2-HIGH' OR (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O') OR o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW'))"""


def _cohort_sql(buckets, who="people", what="act", as_of=RETENTION_AS_OF):
    flags = ", ".join(
        f"bool_or(happened >= created_at + INTERVAL {lo} DAY AND happened < created_at + INTERVAL {hi} DAY) AS {n}" for n, lo, hi in buckets
    )
    cols = ", ".join(
        f"count(*) FILTER (WHERE {n}) AS {n}_users, round(100.0 * count(*) FILTER (WHERE {n}) / count(*), 1) AS {n}_pct" for n, _, _ in buckets
    )
    mature = ", ".join(
        f"DATE '{as_of}' >= cohort_week + {d} AS has_{n}_data" for n, d in A.MATURE_AFTER.items() if n in {b[0] for b in buckets}
    )
    return f"""cohorts AS (SELECT cohort_week, count(*) AS cohort_size, round(100.0 * count(*) FILTER (WHERE day0) / count(*), 1) AS day0_activation_pct,
      {cols}, {mature} FROM (SELECT id, CAST(date_trunc('week', created_at) AS DATE) AS cohort_week,
        bool_or(CAST(happened AS DATE) = CAST(created_at AS DATE)) AS day0, {flags} FROM {who} LEFT JOIN {what} ON user_id = id GROUP BY id, created_at)
      GROUP BY cohort_week)"""


def _order_activity(p, feature):
    orders = p.table("orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "completed").otherwise("failed").alias("status"),
        "o_orderpriority",
    )

    def of(*kinds):
        return orders.filter(F.col("o_orderpriority").isin(*kinds))

    return A.retention_activity(
        feature,
        coaching=of("1-URGENT"),
        lesson_plans=of("2-HIGH"),
        reading=of("3-MEDIUM"),
        chat=of("4-NOT SPECIFIED", "5-LOW"),
    )


def _people(p):
    return p.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_at"))


def _cohorts(p):
    return A.retention_cohorts(_people(p), _order_activity(p, "overall"), RETENTION_AS_OF)


@query("A13_retention_cohorts", f"{_START}, {_ACTIVE}, {_cohort_sql(A.BUCKETS)} SELECT * FROM cohorts")
def a13(spark, folder):
    return _cohorts(Programme(spark, folder))


@query(
    "A13_retention_feature",
    f"""{_START}, act AS (SELECT o_custkey AS user_id, o_orderdate AS happened FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'),
    who AS (SELECT * FROM people WHERE created_at >= DATE '1995-01-15' AND created_at <= DATE '1995-09-30'), {_cohort_sql(A.BUCKETS, 'who')}
    SELECT * FROM cohorts""",
)
def a13_feature(spark, folder):
    p = Programme(spark, folder)
    return A.retention_cohorts(_people(p), _order_activity(p, "coaching"), RETENTION_AS_OF, "1995-01-15", "1995-09-30")


@query(
    "A13_retention_snapshot",
    f"""{_START}, {_ACTIVE}, who AS (SELECT * FROM people WHERE created_at >= TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 84 DAY),
    near AS (SELECT * FROM act WHERE happened >= TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 112 DAY), {_cohort_sql(A.BUCKETS[:4], 'who', 'near')}
    SELECT *, 'overall' AS feature_type FROM cohorts""",
)
def a13_snapshot(spark, folder):
    p = Programme(spark, folder)
    return A.retention_snapshot(_people(p), _order_activity(p, "overall"), RETENTION_AS_OF)


@query(
    "A13_one_week_edge",
    over_programme(f"""
    WITH people AS (SELECT id, created_at FROM users WHERE created_at IS NOT NULL), act AS (SELECT user_id, created_at AS happened FROM ev WHERE event_type <> 'view'),
    {_cohort_sql(A.BUCKETS, as_of='2024-01-29')} SELECT * FROM cohorts"""),
)
def a13_edge(spark, folder):
    p = Programme(spark, folder)
    act = p.ev.filter("event_type <> 'view'").select("user_id", F.col("created_at").alias("at"))
    return A.retention_cohorts(p.users, act, "2024-01-29")


def _tenth(x):
    return f"floor(({x}) * 10 + 0.5) / 10"


_TREND = "coalesce(avg({c}) FILTER (WHERE rn <= 4), 0) - coalesce(avg({c}) FILTER (WHERE rn BETWEEN 5 AND 8), 0)"
_OVERALL = f"{_START}, {_ACTIVE}, {_cohort_sql(A.BUCKETS)}"


@query(
    "A14_retention_summary",
    f"""{_OVERALL}, r AS (SELECT *, row_number() OVER (ORDER BY cohort_week DESC) AS rn FROM cohorts)
    SELECT CAST(floor(avg(cohort_size) + 0.5) AS BIGINT) AS avg_cohort_size, {_tenth('avg(week1_pct) FILTER (WHERE has_week2_data)')} AS avg_week1_retention,
      {_tenth('avg(week4_pct) FILTER (WHERE has_week4_data)')} AS avg_week4_retention, {_tenth('avg(day0_activation_pct)')} AS avg_day0_activation,
      CAST(sum(cohort_size) AS BIGINT) AS total_users, count(*) AS active_cohorts, {_tenth(_TREND.format(c='week1_pct'))} AS week1_trend,
      {_tenth(_TREND.format(c='day0_activation_pct'))} AS activation_trend, max_by(cohort_size, cohort_week) AS latest_cohort_size,
      max(cohort_week) AS latest_cohort_week FROM r""",
)
def a14(spark, folder):
    return A.retention_summary(_cohorts(Programme(spark, folder)))


_POINTS = [("Day 0", "100.0", "true"), ("Week 1", "week1_pct", "true")] + [
    (label, f"{n}_pct", f"has_{n}_data")
    for label, n in (("Week 2", "week2"), ("Week 3", "week3"), ("Week 4", "week4"), ("Week 5-8", "week5_8"), ("Week 9-12", "week9_12"))
]
_LINES = " UNION ALL ".join(
    f"SELECT CAST(cohort_week AS VARCHAR) AS series, {i} AS point, '{label}' AS label, CASE WHEN {flag} THEN CAST({pct} AS DOUBLE) END AS pct FROM top"
    for i, (label, pct, flag) in enumerate(_POINTS)
)
_MEANS = " UNION ALL ".join(
    f"SELECT 'Average' AS series, {i} AS point, '{label}' AS label, {_tenth(f'avg(CAST({pct} AS DOUBLE)) FILTER (WHERE {flag})')} AS pct FROM cohorts HAVING count(*) > 1"
    for i, (label, pct, flag) in enumerate(_POINTS)
)


@query(
    "A14_retention_curve",
    f"{_OVERALL}, top AS (SELECT * FROM cohorts ORDER BY cohort_week DESC LIMIT 3) {_LINES} UNION ALL {_MEANS}",
)
def a14_curve(spark, folder):
    return A.retention_curve(_cohorts(Programme(spark, folder)))


@query(
    "A14_compare_cohorts",
    f"""{_OVERALL} SELECT a.cohort_week AS first_week, b.cohort_week AS second_week, b.cohort_size - a.cohort_size AS size_change,
      {_tenth('b.day0_activation_pct - a.day0_activation_pct')} AS day0_change, {_tenth('b.week1_pct - a.week1_pct')} AS week1_change,
      CASE WHEN a.has_week2_data AND b.has_week2_data THEN {_tenth('b.week2_pct - a.week2_pct')} END AS week2_change,
      CASE WHEN a.has_week3_data AND b.has_week3_data THEN {_tenth('b.week3_pct - a.week3_pct')} END AS week3_change,
      CASE WHEN a.has_week4_data AND b.has_week4_data THEN {_tenth('b.week4_pct - a.week4_pct')} END AS week4_change
    FROM cohorts a, cohorts b WHERE a.cohort_week = DATE '1995-02-06' AND b.cohort_week = DATE '1995-05-15'""",
)
def a14_compare(spark, folder):
    return A.compare_cohorts(_cohorts(Programme(spark, folder)), "1995-02-06", "1995-05-15")


@query(
    "A14_heat_band",
    f"""{_OVERALL} SELECT cohort_week, CASE WHEN NOT has_week4_data THEN 'na' WHEN week4_pct >= 50 THEN 'excellent' WHEN week4_pct >= 40 THEN 'good' WHEN week4_pct >= 30 THEN 'moderate'
      WHEN week4_pct >= 20 THEN 'fair' WHEN week4_pct >= 10 THEN 'poor' ELSE 'critical' END AS band FROM cohorts""",
)
def a14_heat(spark, folder):
    cohorts = _cohorts(Programme(spark, folder))
    return cohorts.select("cohort_week", A.heat_band(F.when(F.col("has_week4_data"), F.col("week4_pct"))).alias("band"))


_ROLLUP = f"""rollup_ AS (SELECT left(phone_number, 2) AS country_code, count(*) AS total_users, count(*) FILTER (WHERE registration_completed) AS registered_users,
      count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 1 DAY) AS new_users_today, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS new_users_week,
      CAST(coalesce(sum(n), 0) AS BIGINT) AS total_messages, CAST(coalesce(sum(td), 0) AS BIGINT) AS messages_today,
      count(*) FILTER (WHERE last_at >= {NOW} - INTERVAL 1 DAY) AS daily_active_users, count(*) FILTER (WHERE last_at >= {NOW} - INTERVAL 7 DAY) AS weekly_active_users,
      CAST(coalesce(sum(a), 0) AS BIGINT) AS total_lesson_plans, CAST(coalesce(sum(b), 0) AS BIGINT) AS total_coaching_sessions,
      CAST(coalesce(sum(c), 0) AS BIGINT) AS total_reading_assessments, CAST(coalesce(sum(d), 0) AS BIGINT) AS total_video_requests
    FROM users LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 1 DAY) AS td, max(created_at) AS last_at FROM chat GROUP BY user_id) m ON m.user_id = id
    LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'signup') AS b,
      count(*) FILTER (WHERE event_type = 'error') AS c, count(*) FILTER (WHERE event_type = 'view') AS d FROM ev GROUP BY user_id) f ON f.user_id = id
    WHERE NOT coalesce(is_test_user, false) GROUP BY ALL)"""


@query("A15_country_rollup", over_programme(f"WITH {_ROLLUP} SELECT * FROM rollup_"))
def a15(spark, folder):
    p, t = tables(spark, folder)
    return A.country_rollup(t, p.lesson_plans, AS_OF)


@query(
    "A15_scoped_stats_country",
    over_programme(f"""
    WITH {_ROLLUP} SELECT CAST(sum(total_users) AS BIGINT) AS total_users, CAST(sum(registered_users) AS BIGINT) AS registered_users, CAST(sum(total_messages) AS BIGINT) AS total_messages,
      CAST(sum(daily_active_users) AS BIGINT) AS daily_active_users, CAST(sum(weekly_active_users) AS BIGINT) AS weekly_active_users
    FROM rollup_ WHERE country_code IN ('11', '23')"""),
)
def a15_country(spark, folder):
    p, t = tables(spark, folder)
    activity = P.scope_columns(J.users_with_activity(p.users, p.chat))
    scope = {"type": "country", "value": {"country_codes": ["+11", "23"]}}
    return A.scoped_stats(A.country_rollup(t, p.lesson_plans, AS_OF), activity, scope, AS_OF)


@query(
    "A15_scoped_stats_school",
    over_programme(f"""
    SELECT count(*) AS total_users, count(*) FILTER (WHERE registration_completed) AS registered_users, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_messages,
      count(*) FILTER (WHERE last_at >= {NOW} - INTERVAL 1 DAY) AS daily_active_users, count(*) FILTER (WHERE last_at >= {NOW} - INTERVAL 7 DAY) AS weekly_active_users
    FROM users LEFT JOIN (SELECT user_id, count(*) AS n, max(created_at) AS last_at FROM chat GROUP BY user_id) ON user_id = id
    WHERE NOT coalesce(is_test_user, false) AND lower(school_name) = 'building'"""),
)
def a15_school(spark, folder):
    p, t = tables(spark, folder)
    activity = P.scope_columns(J.users_with_activity(p.users, p.chat))
    scope = {"type": "school", "value": {"school_names": ["Building"]}}
    return A.scoped_stats(A.country_rollup(t, p.lesson_plans, AS_OF), activity, scope, AS_OF)


@query(
    "A16_users_with_counts",
    over_programme("""
    SELECT id, concat(first_name, ' ', last_name) AS name, phone_number AS phone, n AS count
    FROM users JOIN (SELECT user_id, count(*) AS n FROM videos GROUP BY user_id) ON user_id = id"""),
)
def a16(spark, folder):
    p = Programme(spark, folder)
    return A.users_with_counts(p.users, p.videos)


@query(
    "A38_programme_counts",
    over_programme(f"""
    SELECT (SELECT count(*) FROM users WHERE registration_completed AND NOT coalesce(is_test_user, false)) AS teachers,
      (SELECT count(DISTINCT user_id) FROM chat WHERE role = 'user' AND created_at >= {NOW} - INTERVAL 7 DAY) AS active_teachers_7d,
      (SELECT count(*) FROM lesson_plans WHERE created_at >= {NOW} - INTERVAL 30 DAY) AS lesson_plans_30d"""),
)
def a38(spark, folder):
    p = Programme(spark, folder)
    return A.programme_counts(p.users, p.chat, p.lesson_plans, AS_OF)


@query(
    "A43_derived_counters",
    """SELECT conv_id AS session_id, count(*) AS message_count, count(*) FILTER (WHERE role = 'assistant') AS turn_count FROM conversations GROUP BY conv_id""",
)
def a43(spark, folder):
    rows = Programme(spark, folder).table("conversations").withColumnRenamed("conv_id", "session_id")
    return A.session_counters(rows)


@query(
    "A43_student_counts",
    "SELECT c_nationkey AS list_id, count(*) FILTER (WHERE c_acctbal > 0) AS student_count FROM customer GROUP BY c_nationkey",
)
def a43_students(spark, folder):
    rows = Programme(spark, folder).table("customer")
    return A.student_counts(rows.select(F.col("c_nationkey").alias("list_id"), (F.col("c_acctbal") > 0).alias("is_active")))


# T, U, D ---------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted({*U.ENGLISH_STOP, *U.URDU_STOP}))
WORDS_SQL = (
    "list_filter(string_split_regex(regexp_replace(lower({t}), '[^\\w\\s]', ' ', 'g'), '\\s+'), "
    f"lambda w: length(w) BETWEEN 3 AND 19 AND NOT list_contains([{_STOP}], w) AND NOT regexp_full_match(w, '[0-9]+'))"
)


@query(
    "T1_page",
    over_programme("""
    SELECT id, last_at AS last_activity, coalesce(n, 0) AS total_messages FROM users
    LEFT JOIN (SELECT user_id, count(*) AS n, max(created_at) AS last_at FROM chat GROUP BY user_id) ON user_id = id
    ORDER BY last_at DESC NULLS LAST, users.created_at DESC NULLS FIRST, id LIMIT 50 OFFSET 100"""),
)
def t1(spark, folder):
    p = Programme(spark, folder)
    rows = J.users_with_activity(p.users, p.chat)
    return U.page(rows, J.activity_order(), 50, 100).select("id", "last_activity", "total_messages")


@query(
    "T2_word_frequency",
    f"""SELECT word, count(*) AS count FROM (SELECT unnest({WORDS_SQL.format(t='text')}) AS word FROM conversations WHERE role = 'user')
    GROUP BY word ORDER BY count DESC, word LIMIT 100""",
)
def t2(spark, folder):
    rows = Programme(spark, folder).table("conversations").filter(F.col("role") == "user")
    return U.word_frequency(rows, "text", 100)


@query(
    "T2_word_counts_documents",
    f"SELECT source, word, count(*) AS count FROM (SELECT source, unnest({WORDS_SQL.format(t='text')}) AS word FROM documents) GROUP BY source, word",
)
def t2_documents(spark, folder):
    return U.word_counts(Programme(spark, folder).table("documents"), "text", ["source"])


@query(
    "T3_engagement_keywords",
    f"""WITH busy AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 4 ORDER BY n DESC, conv_id LIMIT 100)
    SELECT word, count(*) AS count FROM (SELECT unnest({WORDS_SQL.format(t='text')}) AS word FROM conversations
      WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM busy)) GROUP BY word ORDER BY count DESC, word LIMIT 20""",
)
def t3(spark, folder):
    return U.engagement_keywords(Programme(spark, folder).table("conversations"), "conv_id", "text", 4)


@query(
    "U1_activity_timeline",
    over_programme("""
    SELECT user_id, created_at AS at, 'conversation' AS activity_type FROM chat WHERE role = 'user' UNION ALL SELECT user_id, created_at, 'lesson_plan' FROM lesson_plans
    UNION ALL SELECT user_id, created_at, 'coaching' FROM coaching UNION ALL SELECT user_id, created_at, 'reading' FROM reading"""),
)
def u1(spark, folder):
    p = Programme(spark, folder)
    return U.activity_timeline(
        {
            "conversation": (p.chat, "created_at"),
            "lesson_plan": (p.lesson_plans, "created_at"),
            "coaching": (p.coaching, "created_at"),
            "reading": (p.reading, "created_at"),
        },
        user_only=["conversation"],
    )


@query("U2_any_feature_users", over_programme("SELECT DISTINCT user_id FROM ev WHERE event_type IN ('purchase', 'signup', 'error')"))
def u2(spark, folder):
    p = Programme(spark, folder)
    return U.any_feature_users(p.lesson_plans, p.coaching, p.reading)


@query(
    "U3_feature_membership",
    over_programme("""
    SELECT user_id, bool_or(event_type = 'purchase') AS lesson_plans, bool_or(event_type = 'view' AND k < 10) AS videos, bool_or(event_type = 'error' AND value > 90) AS reading,
      bool_or(event_type = 'signup' AND value < 10) AS coaching FROM ev
    WHERE event_type = 'purchase' OR (event_type = 'view' AND k < 10) OR (event_type = 'error' AND value > 90) OR (event_type = 'signup' AND value < 10) GROUP BY user_id"""),
)
def u3(spark, folder):
    p = Programme(spark, folder)
    return U.feature_membership(
        lesson_plans=p.lesson_plans, videos=p.videos.filter("k < 10"), reading=p.reading.filter("value > 90"), coaching=p.coaching.filter("value < 10")
    )


@query(
    "U3_only_in_first",
    over_programme("SELECT user_id FROM videos WHERE k < 10 EXCEPT SELECT user_id FROM reading WHERE value > 90"),
)
def u3_only(spark, folder):
    p = Programme(spark, folder)
    return U.only_in_first(p.videos.filter("k < 10"), p.reading.filter("value > 90"))


@query(
    "U3_in_both",
    over_programme("SELECT user_id FROM videos WHERE k < 10 INTERSECT SELECT user_id FROM reading WHERE value > 90"),
)
def u3_both(spark, folder):
    p = Programme(spark, folder)
    return U.in_both(p.videos.filter("k < 10"), p.reading.filter("value > 90"))


@query(
    "D1_repeat_within",
    over_programme("""
    SELECT id, event_type, k, created_at, coalesce(created_at - lag(created_at) OVER (PARTITION BY event_type, k ORDER BY created_at, id) <= INTERVAL 4 HOUR, false) AS is_repeat
    FROM ev"""),
)
def d1(spark, folder):
    rows = U.repeat_within(Programme(spark, folder).ev, ["event_type", "k"], seconds=4 * 3600)
    return rows.select("id", "event_type", "k", "created_at", "is_repeat")


@query(
    "D1_cooling_down",
    over_programme(f"""
    SELECT user_id, max(created_at) AS last_completed FROM videos WHERE status = 'completed' AND created_at >= {NOW} - INTERVAL 1 DAY AND created_at <= {NOW} GROUP BY user_id"""),
)
def d1_cooling(spark, folder):
    rows = Programme(spark, folder).videos.withColumn("completed_at", F.col("created_at"))
    return U.cooling_down(rows, "user_id", AS_OF, seconds=86400)


@query("D2_distinct_grades", "SELECT DISTINCT p_size FROM part WHERE p_type = 'ECONOMY'")
def d2(spark, folder):
    return U.distinct_cascade(Programme(spark, folder).table("part"), "p_size", p_type="ECONOMY")


@query("D2_distinct_topics", "SELECT DISTINCT p_name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#17' AND trim(p_name) <> ''")
def d2_topics(spark, folder):
    return U.distinct_cascade(Programme(spark, folder).table("part"), "p_name", p_type="ECONOMY", p_brand="Brand#17")
