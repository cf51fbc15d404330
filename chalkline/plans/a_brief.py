"""Registered queries for A17 to A29 over orders as events and customers as teachers."""

import datetime as dt

from pyspark.sql import functions as F

from chalkline.functions import dates
from chalkline.operators import brief as B
from chalkline.operators import filters as P
from chalkline.plans.registry import query
from chalkline.plans.standins import ORDER_DAY, Programme, over_programme

DAY = dt.date.fromisoformat(ORDER_DAY)
_SOURCES = {
    "lps": ("1-URGENT", "created_at"),
    "coach": ("2-HIGH", "created_at"),
    "reading": ("3-MEDIUM", "created_at"),
    "chat": ("4-NOT SPECIFIED", "created_at"),
    "quiz": ("5-LOW", "created_at"),
}


def _orders(p):
    score = F.floor(F.col("o_totalprice") / 5000).cast("int")
    return p.table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("kind"),
        score.alias("score"),
    )


def _cohort(p):
    return P.teacher_cohort(p.users, "school_name")


def _facts(p, days, panels_only=False):
    orders = _orders(p)
    names = ["lps", "coach", "reading"] if panels_only else list(_SOURCES)
    sources = {}
    for name in names:
        code, ts = _SOURCES[name]
        done = F.col("status") != "F" if panels_only and name in ("coach", "reading") else None
        if not panels_only and name == "chat":
            done = F.col("status") == "O"
        sources[name] = (orders.filter(F.col("kind") == code).drop("kind"), ts, done)
    return B.brief_facts(_cohort(p), sources, DAY - dt.timedelta(days=days), DAY)


_BASE = """WITH cohort AS (SELECT id, nullif(trim(school_name), '') AS unit FROM users WHERE registration_completed AND NOT coalesce(is_test_user, false)),
  o AS (SELECT o_orderkey AS oid, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS status, o_orderpriority AS pr, unit,
    CAST(floor(o_totalprice / 5000) AS INTEGER) AS score FROM orders JOIN cohort ON id = o_custkey),
  act AS (SELECT user_id, d, unit FROM o WHERE pr <> '4-NOT SPECIFIED' OR status = 'O'),
  pan AS (SELECT user_id, d, unit, CASE pr WHEN '1-URGENT' THEN 'lps' WHEN '2-HIGH' THEN 'coach' ELSE 'reading' END AS kind FROM o
    WHERE pr = '1-URGENT' OR (pr IN ('2-HIGH', '3-MEDIUM') AND status <> 'F'))"""


def _panel(key, spine):
    return f"""SELECT s.{key},
      coalesce(lps, 0) AS lps, coalesce(lp_teachers, 0) AS lp_teachers, coalesce(coach, 0) AS coach, coalesce(coach_teachers, 0) AS coach_teachers,
      coalesce(reading, 0) AS reading, coalesce(reading_teachers, 0) AS reading_teachers, coalesce(active, 0) AS active{{extra}}
    FROM {spine} s LEFT JOIN (SELECT {key}, count(*) FILTER (WHERE kind = 'lps') AS lps, count(DISTINCT user_id) FILTER (WHERE kind = 'lps') AS lp_teachers,
        count(*) FILTER (WHERE kind = 'coach') AS coach, count(DISTINCT user_id) FILTER (WHERE kind = 'coach') AS coach_teachers,
        count(*) FILTER (WHERE kind = 'reading') AS reading, count(DISTINCT user_id) FILTER (WHERE kind = 'reading') AS reading_teachers FROM p GROUP BY {key}) a ON a.{key} = s.{key}
      LEFT JOIN (SELECT {key}, count(DISTINCT user_id) AS active FROM a GROUP BY {key}) b ON b.{key} = s.{key}"""


@query(
    "A17_brief_daily",
    over_programme(f"""{_BASE}, p AS (SELECT * FROM pan), a AS (SELECT * FROM act),
    spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{ORDER_DAY}' - INTERVAL 13 DAY, TIMESTAMP '{ORDER_DAY}', INTERVAL 1 DAY)) AS DATE) AS d)
    {_panel('d', 'spine').format(extra='')}"""),
)
def a17(spark, folder):
    p = Programme(spark, folder)
    return B.brief_daily(_facts(p, 13), _facts(p, 13, True), DAY)


@query(
    "A18_brief_daily_by_unit",
    over_programme(f"""{_BASE},
    spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{ORDER_DAY}' - INTERVAL 13 DAY, TIMESTAMP '{ORDER_DAY}', INTERVAL 1 DAY)) AS DATE) AS d),
    units AS (SELECT DISTINCT coalesce(unit, 'No unit recorded') AS unit FROM cohort)
    SELECT s.d, u.unit, count(DISTINCT user_id) FILTER (WHERE kind = 'lps') AS lp_teachers, count(DISTINCT user_id) FILTER (WHERE kind = 'coach') AS coach_teachers
    FROM spine s CROSS JOIN units u LEFT JOIN pan ON pan.d = s.d AND coalesce(pan.unit, 'No unit recorded') = u.unit
    WHERE (SELECT count(*) FROM units) <= 8 GROUP BY s.d, u.unit"""),
)
def a18(spark, folder):
    p = Programme(spark, folder)
    return B.brief_daily_by_unit(_facts(p, 13, True), _cohort(p), DAY)


@query(
    "A19_brief_weekly",
    over_programme(f"""{_BASE}, p AS (SELECT *, CAST(floor((DATE '{ORDER_DAY}' - d) / 7.0) AS INTEGER) AS k FROM pan WHERE d <= DATE '{ORDER_DAY}'),
    a AS (SELECT *, CAST(floor((DATE '{ORDER_DAY}' - d) / 7.0) AS INTEGER) AS k FROM act WHERE d <= DATE '{ORDER_DAY}'),
    spine AS (SELECT CAST(k AS INTEGER) AS k FROM generate_series(0, 7) AS t(k))
    {_panel('k', 'spine').format(extra=f", DATE '{ORDER_DAY}' - (s.k * 7 + 6) AS week_start, DATE '{ORDER_DAY}' - s.k * 7 AS week_end")}"""),
)
def a19(spark, folder):
    p = Programme(spark, folder)
    return B.brief_weekly(_facts(p, 55), _facts(p, 55, True), DAY)


_WIN = {"": f"d BETWEEN DATE '{ORDER_DAY}' - 6 AND DATE '{ORDER_DAY}'", "prev_": f"d BETWEEN DATE '{ORDER_DAY}' - 13 AND DATE '{ORDER_DAY}' - 7"}
_TOTALS = ", ".join(
    f"count(*) FILTER (WHERE kind = '{k}' AND {cond}) AS {w}{k}, count(DISTINCT user_id) FILTER (WHERE kind = '{k}' AND {cond}) AS {w}{B.TEACHERS[k]}"
    for w, cond in _WIN.items()
    for k in B.PANELS
)


@query("A20_window_totals", over_programme(f"{_BASE} SELECT {_TOTALS} FROM pan"))
def a20(spark, folder):
    return B.window_totals(_facts(Programme(spark, folder), 13, True), DAY - dt.timedelta(days=6), DAY)


@query(
    "A21_active_summary",
    over_programme(f"""{_BASE} SELECT count(DISTINCT user_id) FILTER (WHERE d = DATE '{ORDER_DAY}') AS active_today,
      count(DISTINCT user_id) FILTER (WHERE d = DATE '{ORDER_DAY}' - 1) AS active_yesterday, count(DISTINCT user_id) FILTER (WHERE {_WIN['']}) AS active_week,
      count(DISTINCT user_id) FILTER (WHERE {_WIN['prev_']}) AS active_prev_week FROM act"""),
)
def a21(spark, folder):
    return B.active_summary(_facts(Programme(spark, folder), 13), DAY)


_BY_UNIT = f"""SELECT unit, count(*) AS registered, count(user_id) AS active FROM cohort
  LEFT JOIN (SELECT DISTINCT user_id FROM act WHERE {_WIN['']}) ON user_id = id GROUP BY unit"""


@query(
    "A21_units_summary",
    over_programme(f"{_BASE} SELECT coalesce(unit, 'No unit recorded') AS name, registered, active AS active_week FROM ({_BY_UNIT})"),
)
def a21_units(spark, folder):
    p = Programme(spark, folder)
    return B.units_summary(_cohort(p), _facts(p, 13), DAY)




def _coaching(p, days):
    """Coaching rows with an analysis JSON of the stored shape."""
    fw = F.when(F.col("score") < 40, "hots").when(F.col("score") < 70, "teach").otherwise("oecd")
    rows = _orders(p).filter((F.col("kind") == "2-HIGH") & (F.col("status") != "F"))
    area = F.struct(
        F.struct(F.col("score").alias("area_score"), F.lit(100).alias("area_max")).alias("climate"),
        F.struct((100 - F.col("score")).alias("area_score"), F.lit(80).alias("area_max")).alias("questions"),
        F.struct(F.lit("none").alias("text")).alias("notes"),
        F.lit(5).alias("plain"),
    )
    overall = F.struct(F.when(F.col("score") < 10, "").otherwise(F.col("score").cast("string")).alias("overall_percentage"))
    early = F.col("created_at") < F.lit("2001-07-10").cast("timestamp")
    data = F.to_json(
        F.struct(
            fw.alias("framework"),
            overall.alias("scores"),
            F.when(~early, area).alias("domains"),
            F.when(early, area).alias("areas"),
        )
    )
    rows = rows.withColumn("analysis_data", data)
    window = P.in_days(rows, "created_at", str(DAY - dt.timedelta(days=days)), str(DAY))
    return B.in_cohort(window, _cohort(p))


_COACH = f"""coach AS (SELECT *, CASE WHEN score < 40 THEN 'hots' WHEN score < 70 THEN 'teach' ELSE 'oecd' END AS fw, CASE WHEN score >= 10 THEN score END AS s
  FROM o WHERE pr = '2-HIGH' AND status <> 'F' AND d BETWEEN DATE '{ORDER_DAY}' - {{days}} AND DATE '{ORDER_DAY}')"""


@query(
    "A22_coaching_summary",
    over_programme(f"""{_BASE}, {_COACH.format(days=29)} SELECT count(*) AS sessions, count(DISTINCT user_id) AS teachers, round(avg(s), 1) AS avg_score,
      (SELECT fw FROM coach GROUP BY fw ORDER BY count(*) DESC, fw LIMIT 1) AS framework FROM coach"""),
)
def a22(spark, folder):
    return B.coaching_summary(_coaching(Programme(spark, folder), 29))


@query(
    "A23_score_trend",
    over_programme(f"{_BASE}, {_COACH.format(days=59)} SELECT d, round(avg(s), 1) AS avg_score, count(*) AS n FROM coach WHERE s IS NOT NULL GROUP BY d"),
)
def a23(spark, folder):
    return B.score_trend(_coaching(Programme(spark, folder), 59))


@query(
    "A24_domain_breakdown",
    over_programme(f"""{_BASE}, {_COACH.format(days=29)}, parts AS (SELECT 'climate' AS key, score / 100 AS share FROM coach UNION ALL SELECT 'questions', (100 - score) / 80 FROM coach)
    SELECT key, round(avg(share) * 100, 1) AS pct, count(*) AS n FROM parts GROUP BY key"""),
)
def a24(spark, folder):
    return B.domain_breakdown(_coaching(Programme(spark, folder), 29))


@query(
    "A25_reading_summary",
    over_programme("""
    SELECT count(*) AS assessments, count(DISTINCT coalesce(student_identifier, CAST(id AS VARCHAR))) AS students,
      round(100.0 * count(*) FILTER (WHERE on_track) / count(on_track), 1) AS on_track_pct FROM reading WHERE status = 'completed'"""),
)
def a25(spark, folder):
    return B.reading_summary(Programme(spark, folder).reading.filter("status = 'completed'"))


@query(
    "A25_reading_by_grade",
    over_programme("""
    SELECT grade_level, count(*) AS n, round(quantile_cont(wcpm, 0.5), 1) AS median_wcpm,
      round(100.0 * count(*) FILTER (WHERE on_track) / count(on_track), 1) AS on_track_pct FROM reading WHERE status = 'completed' GROUP BY grade_level"""),
)
def a25_grades(spark, folder):
    return B.reading_by_grade(Programme(spark, folder).reading.filter("status = 'completed'"))


@query(
    "A26_feature_strip",
    over_programme(f"""{_BASE} SELECT CASE pr WHEN '1-URGENT' THEN 'lps' WHEN '2-HIGH' THEN 'coach' WHEN '3-MEDIUM' THEN 'reading' WHEN '4-NOT SPECIFIED' THEN 'chat' ELSE 'quiz' END AS kind,
      count(*) FILTER (WHERE {_WIN['']}) AS n, count(*) FILTER (WHERE {_WIN['prev_']}) AS prev FROM o
      WHERE (pr <> '4-NOT SPECIFIED' OR status = 'O') AND d BETWEEN DATE '{ORDER_DAY}' - 13 AND DATE '{ORDER_DAY}' GROUP BY 1"""),
)
def a26(spark, folder):
    return B.feature_strip(_facts(Programme(spark, folder), 13), DAY - dt.timedelta(days=6), DAY)


@query(
    "A27_unit_attention",
    over_programme(f"""{_BASE} SELECT unit, registered, active AS active_7d, CAST(round_even(100 * active / registered, 0) AS INTEGER) AS pct
    FROM ({_BY_UNIT}) WHERE unit IS NOT NULL"""),
)
def a27(spark, folder):
    p = Programme(spark, folder)
    return B.unit_attention(_cohort(p), _facts(p, 6), DAY)


@query("A27_unmapped", over_programme(f"{_BASE} SELECT count(*) FILTER (WHERE unit IS NULL) AS unmapped_teachers FROM cohort"))
def a27_unmapped(spark, folder):
    return B.unmapped_teachers(_cohort(Programme(spark, folder)))


def _observations(p):
    lines = p.table("lineitem").join(p.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("l_quantity") > 3, F.col("l_suppkey")).alias("observer_user_id"),
        F.to_date("l_shipdate").alias("d"),
    )


_OBS = f"""obs AS (SELECT o_custkey AS user_id, CASE WHEN l_quantity > 3 THEN l_suppkey END AS observer_user_id, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  t AS (SELECT r.observer_user_id, count(obs.d) AS n FROM (SELECT DISTINCT observer_user_id FROM obs JOIN cohort ON id = user_id WHERE observer_user_id IS NOT NULL) r
    LEFT JOIN obs ON obs.observer_user_id = r.observer_user_id AND {_WIN['']} GROUP BY r.observer_user_id)"""


@query("A28_observer_targets", over_programme(f"{_BASE}, {_OBS} SELECT observer_user_id, n, n >= 10 AS hit, n > 10 AS above FROM t"))
def a28(spark, folder):
    p = Programme(spark, folder)
    return B.observer_targets(_observations(p), _cohort(p), DAY, "weekly")


@query(
    "A28_observer_summary",
    over_programme(f"{_BASE}, {_OBS} SELECT count(*) AS roster_size, count(*) FILTER (WHERE n >= 10) AS hit, count(*) FILTER (WHERE n > 10) AS above, 5 AS working_days FROM t"),
)
def a28_summary(spark, folder):
    p = Programme(spark, folder)
    return B.observer_summary(B.observer_targets(_observations(p), _cohort(p), DAY, "weekly"), 5)


_DELTA = """CASE WHEN a IS NULL OR b IS NULL THEN 'no earlier data' WHEN a = b THEN 'no change'
  WHEN a < 20 OR b < 20 THEN CASE WHEN round_even(a - b, 0) > 0 THEN '▲ ' ELSE '▼ ' END || CAST(CAST(abs(round_even(a - b, 0)) AS BIGINT) AS VARCHAR)
  ELSE CASE WHEN round_even((a - b) * 100 / b, 0) > 0 THEN '▲ ' ELSE '▼ ' END || CAST(CAST(abs(round_even((a - b) * 100 / b, 0)) AS BIGINT) AS VARCHAR) || '%' END"""


@query(
    "A29_delta",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(nullif(l_quantity, 7) AS DOUBLE) AS a,
      CAST(lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS DOUBLE) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_DELTA} AS change,
      CASE WHEN a IS NULL OR b IS NULL THEN 'no earlier data' WHEN round_even(a - b, 0) = 0 THEN 'no change'
        ELSE CASE WHEN a > b THEN '▲ ' ELSE '▼ ' END || CAST(CAST(abs(round_even(a - b, 0)) AS BIGINT) AS VARCHAR) || 'pt' END AS points FROM x""",
)
def a29(spark, folder):
    from chalkline.operators.ordered import carry_lag, position_chunk

    lines = Programme(spark, folder).table("lineitem")
    lagged = carry_lag(
        lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_quantity"], position_chunk("l_linenumber")
    )
    cur, prev = F.nullif("l_quantity", F.lit(7.0)), F.col("prev_l_quantity")
    return lagged.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", B.delta(cur, prev).alias("change"), B.delta(cur, prev, "pct").alias("points")
    )


@query(
    "F1_dates",
    over_programme("""SELECT id, CASE WHEN month(d) BETWEEN 8 AND 11 THEN 'fall' WHEN month(d) IN (12, 1, 2) THEN 'winter' ELSE 'spring' END AS season,
      CAST(date_trunc('week', d) AS DATE) AS week_start,
      (SELECT max(CAST(x AS DATE)) FROM generate_series(d - INTERVAL 4 DAY, d - INTERVAL 1 DAY, INTERVAL 1 DAY) AS t(x) WHERE isodow(x) <= 5) AS previous_working_day,
      CAST(greatest((SELECT count(*) FROM generate_series(CAST(d AS TIMESTAMP), d + to_days(k), INTERVAL 1 DAY) AS t(x) WHERE isodow(x) <= 5), 1) AS INTEGER) AS working_days,
      d - 6 AS window_lo, CASE WHEN isodow(d) = 5 THEN 'weekly' WHEN isodow(d) < 5 THEN 'daily' END AS kind
    FROM (SELECT id, k, CAST(created_at AS DATE) + k * 3 AS d FROM ev) e"""),
)
def f1(spark, folder):
    day = F.date_add(F.to_date("created_at"), F.col("k") * 3)
    rows = Programme(spark, folder).ev.select("id", "k", day.alias("d"))
    return rows.select(
        "id",
        dates.season(F.col("d")).alias("season"),
        dates.week_start(F.col("d")).alias("week_start"),
        dates.previous_working_day(F.col("d")).alias("previous_working_day"),
        dates.working_days(F.col("d"), F.date_add("d", F.col("k"))).alias("working_days"),
        dates.weekly_window(F.col("d"))["lo"].alias("window_lo"),
        dates.brief_kind(F.col("d")).alias("kind"),
    )
