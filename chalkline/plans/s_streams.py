"""Registered S, ST and N queries."""

from pyspark.sql import functions as F

from chalkline.functions.named import register_functions
from chalkline.operators import brief as B
from chalkline.operators import graph as G
from chalkline.operators import stats as A
from chalkline.plans.a_brief import _BASE, DAY, _cohort, _facts
from chalkline.plans.a_stats import tables
from chalkline.plans.g_graph import segments
from chalkline.plans.p_joins import _WORD_VALUES
from chalkline.plans.registry import query
from chalkline.plans.standins import AS_OF, ORDER_DAY, Programme, over_programme
from chalkline.plans.w_quiz import _DOCS, _FOCUS_SQL
from chalkline.sources import corpora
from chalkline.sources import sinks as S
from chalkline.sources.parts import pointer, read_parts
from chalkline.streaming import run
from chalkline.streaming import streams as ST

_ALL = "region nation customer supplier part orders lineitem events documents labels conversations embeddings pages benchmark".split()


@query("S1_load", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _ALL))
def s1(spark, folder):
    p = Programme(spark, folder)
    out = None
    for name in _ALL:
        part = p.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "S2_segments",
    """SELECT 'grade_' || p_size % 5 || '_' || lower(right(p_brand, 1)) || '_set' AS book_id, CAST(p_size % 5 AS VARCHAR) AS grade, lower(right(p_brand, 1)) || ' set' AS subject,
        CAST(row_number() OVER (PARTITION BY p_size % 5, lower(right(p_brand, 1)) ORDER BY p_partkey) - 1 AS INTEGER) AS position, p_partkey AS segment_index, p_type AS topic, p_name AS skill_type FROM part""",
)
def s2(spark, folder):
    """Parts written as segment files, half of them as a list and half as an object, and parsed again."""
    parts = Programme(spark, folder).table("part")
    segment = F.struct(F.col("p_partkey").alias("segment_index"), F.col("p_type").alias("topic"), F.col("p_name").alias("skill_type"))
    books = parts.groupBy((F.col("p_size") % 5).alias("grade"), F.lower(F.right("p_brand", F.lit(1))).alias("set")).agg(F.to_json(F.sort_array(F.collect_list(segment))).alias("listed"))
    files = books.select(
        F.concat(F.lit("/corpus/grade_"), F.col("grade").cast("string"), F.lit("_"), F.col("set"), F.lit("_set_full_segments.json")).alias("path"),
        F.when(F.col("grade") % 2 == 0, F.col("listed")).otherwise(F.concat(F.lit('{"segments": '), F.col("listed"), F.lit("}"))).alias("value"),
    )
    return corpora.parse_segments(files).select("book_id", "grade", "subject", "position", "segment_index", "topic", "skill_type")


@query(
    "S3_ledger_counts",
    """SELECT count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS stamped, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS malformed FROM orders""",
)
def s3(spark, folder):
    """Orders as ledger lines; some lack a key, some break off."""
    key = F.col("o_orderkey")
    line = F.to_json(
        F.struct(
            F.col("o_orderdate").cast("string").alias("ts"),
            F.col("o_orderpriority").alias("stage"),
            F.concat(F.lit("order "), key.cast("string")).alias("unit"),
            F.when(key % 7 != 0, F.col("o_orderstatus")).alias("artifact"),
        )
    )
    lines = Programme(spark, folder).table("orders").select(F.when(key % 11 == 0, F.left(line, F.lit(20))).otherwise(line).alias("value"))
    return corpora.ledger_counts(corpora.parse_ledger(lines))


@query(
    "S4_panel_columns",
    "SELECT column_name, column_name IN ('school_name', 'region', 'organization') AS can_group FROM (DESCRIBE SELECT c_name AS school_name, c_mktsegment AS region, c_acctbal FROM customer)",
)
def s4(spark, folder):
    from chalkline.sources.features import UNIT_COLUMNS, detect_features

    users = Programme(spark, folder).table("customer").select(
        F.col("c_name").alias("school_name"), F.col("c_mktsegment").alias("region"), "c_acctbal"
    )
    found = detect_features({"users": users})
    # one row per column of the table, from its schema
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(found.col("users", c) and c in UNIT_COLUMNS).alias("can_group")) for c in users.columns]
    return users.limit(1).select(F.inline(F.array(*cells)))


_VISIT = "concat('http://site/', event_type, '/', repeat('x', 600))"


@query(
    "S5_append_once",
    over_programme(f"""
    WITH v AS (SELECT k AS session_id, sha256(CAST(user_id AS VARCHAR)) AS ip_hash, left({_VISIT}, 500) AS landing_page, created_at, id FROM ev),
    old AS (SELECT DISTINCT session_id FROM v WHERE created_at < TIMESTAMP '2024-01-01 06:00:00'),
    f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS rn FROM v WHERE created_at >= TIMESTAMP '2024-01-01 06:00:00' AND session_id NOT IN (SELECT session_id FROM old))
    SELECT session_id, ip_hash, landing_page, created_at FROM f WHERE rn = 1"""),
)
def s5(spark, folder):
    ev = Programme(spark, folder).ev
    visits = ev.select(
        F.col("k").alias("session_id"), F.col("user_id").alias("ip"), F.lit("agent").alias("user_agent"), F.expr(_VISIT).alias("landing_page"), F.lit("").alias("referrer"), "created_at"
    )
    rows = S.visit_rows(visits)
    cut = F.lit("2024-01-01 06:00:00").cast("timestamp")
    fresh = S.only_new(rows.filter(F.col("created_at") >= cut), rows.filter(F.col("created_at") < cut), "session_id", ["created_at"])
    return fresh.select("session_id", "ip_hash", "landing_page", "created_at")


@query(
    "S6_export_lines",
    """WITH s AS (SELECT concat('grade_1_', lower(replace(p_brand, '#', '_'))) AS b, CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) AS ch, CAST(p_partkey AS VARCHAR) AS li FROM part),
    e AS (SELECT DISTINCT 'Book' AS sl, b AS s, 'Chapter' AS dl, b || '::ch' || ch AS d FROM s UNION ALL SELECT 'Chapter', b || '::ch' || ch, 'Lesson', b || '::ch' || ch || '::L' || li FROM s)
    SELECT 2 AS place, 'MATCH (a:' || sl || ' {id:"' || s || '"}),(b:' || dl || ' {id:"' || d || '"}) MERGE (a)-[:CONTAINS]->(b);' AS line FROM e""",
)
def s6(spark, folder):
    rows = segments(Programme(spark, folder))
    nodes, edges = G.build_nodes(rows), G.build_edges(rows)
    return S.graph_lines(nodes, edges.filter("rel = 'CONTAINS'"), "cypher").filter("place = 2")


@query(
    "S7_snapshot_status",
    over_programme(f"""
    SELECT 'chat' AS view_name, max(created_at) AS last_refresh, count(*) AS row_count, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(created_at))) / 60000000) AS BIGINT) AS minutes_since_refresh, true AS needs_refresh FROM chat
    UNION ALL SELECT 'sessions', TIMESTAMP '2024-01-31 11:56:00', count(*), 4, false FROM chat_sessions"""),
)
def s7(spark, folder):
    p = Programme(spark, folder)
    stamped = p.chat_sessions.withColumn("last_refreshed", F.lit("2024-01-31 11:56:00"))
    return S.snapshot_status({"chat": p.chat.withColumnRenamed("created_at", "last_refreshed"), "sessions": stamped}, "2024-01-31 12:00:00")


@query(
    "S8_metric_rows",
    over_programme(f"""{_BASE}, a AS (SELECT CAST(count(DISTINCT user_id) FILTER (WHERE d = DATE '{ORDER_DAY}') AS DOUBLE) AS active_today, CAST(count(DISTINCT user_id) FILTER (WHERE d BETWEEN DATE '{ORDER_DAY}' - 6 AND DATE '{ORDER_DAY}') AS DOUBLE) AS active_week,
      CAST(count(DISTINCT user_id) FILTER (WHERE d = DATE '{ORDER_DAY}' - 1) AS DOUBLE) AS active_yesterday, CAST(count(DISTINCT user_id) FILTER (WHERE d BETWEEN DATE '{ORDER_DAY}' - 13 AND DATE '{ORDER_DAY}' - 7) AS DOUBLE) AS active_prev_week FROM act),
    u AS (SELECT coalesce(unit, 'No unit recorded') AS name, CAST(count(*) AS DOUBLE) AS registered, CAST(count(user_id) AS DOUBLE) AS active_week FROM cohort
      LEFT JOIN (SELECT DISTINCT user_id FROM act WHERE d BETWEEN DATE '{ORDER_DAY}' - 6 AND DATE '{ORDER_DAY}') ON user_id = id GROUP BY unit)
    SELECT 'weekly' AS kind, '{ORDER_DAY}' AS day, 'active' AS panel, '{{}}' AS key, metric, value FROM (UNPIVOT a ON active_today, active_week, active_yesterday, active_prev_week INTO NAME metric VALUE value)
    UNION ALL SELECT 'weekly', '{ORDER_DAY}', 'units', '{{"name":"' || name || '"}}', metric, value FROM (UNPIVOT u ON registered, active_week INTO NAME metric VALUE value)"""),
)
def s8(spark, folder):
    p = Programme(spark, folder)
    facts = _facts(p, 13)
    active = S.metric_rows(B.active_summary(facts, DAY), "active", [], "weekly", ORDER_DAY)
    units = S.metric_rows(B.units_summary(_cohort(p), facts, DAY), "units", ["name"], "weekly", ORDER_DAY)
    return active.unionByName(units)


_JOBS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'queued' END AS status, o_orderdate AS completed_at FROM orders"


@query("S9_purge", f"SELECT id FROM ({_JOBS}) WHERE NOT (status IN ('completed', 'failed') AND completed_at < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY)")
def s9(spark, folder):
    """The jobs stored by month, purged, and read back."""
    stored, _ = _purged(spark, folder)
    return read_parts(spark, stored).select("id")


@query("S9_purged_count", f"SELECT count(*) AS deleted FROM ({_JOBS}) WHERE status IN ('completed', 'failed') AND completed_at < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY")
def s9_count(spark, folder):
    return S.purged_count(_jobs(spark, folder), "2001-01-01 00:00:00", 30)


@query("S9_purge_report", f"""SELECT count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS remaining, count(DISTINCT strftime(completed_at, '%Y-%m')) FILTER (NOT gone) AS months
    FROM (SELECT *, status IN ('completed', 'failed') AND completed_at < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY AS gone FROM ({_JOBS}))""")
def s9_report(spark, folder):
    """What the purge says it deleted, and the rows and parts that the table has left."""
    stored, deleted = _purged(spark, folder)
    left = read_parts(spark, stored).agg(F.count("*").alias("remaining"))
    return left.select(F.lit(deleted).cast("bigint").alias("deleted"), "remaining", F.lit(len(pointer(spark, stored)["parts"])).cast("bigint").alias("months"))


def _purged(spark, folder):
    stored = run.work_folder(spark, "jobs")
    S.store_jobs(_jobs(spark, folder), stored)
    return stored, S.purge_table(spark, stored, "2001-01-01 00:00:00", 30)


def _jobs(spark, folder):
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed").otherwise("queued")
    return Programme(spark, folder).table("orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("completed_at")
    )


# ST: the events as a file stream, drained, against the batch truth on what the watermark has closed.
_MARK = "(SELECT max(ts) FROM events)"


@query(
    "ST1_stream_sessions",
    f"""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM m)
    SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS message_count FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK} - INTERVAL 1 HOUR""",
)
def st1(spark, folder):
    return run.drain(ST.stream_sessions(ST.read_stream(spark, "events", folder), "user_id", "ts"), "st1")


@query(
    "ST2_stream_counters",
    "SELECT user_id AS session_id, count(*) AS message_count, count(*) FILTER (WHERE event_type = 'view') AS turn_count FROM events GROUP BY user_id",
)
def st2(spark, folder):
    events = ST.read_stream(spark, "events", folder)
    rows = events.select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "view", "assistant").otherwise("user").alias("role"))
    return _merged(rows, ST.stream_counters, "session_id")


def _merged(rows, counts, key):
    """The counters kept in a table by a stream that is drained."""
    base = run.work_folder(rows.sparkSession, "st2")
    ST.stream_merge(rows, counts, [key], f"{base}/counts", f"{base}/checkpoint", every=None).awaitTermination()
    return ST.read_counts(rows.sparkSession, f"{base}/counts", [key])


_DELIVERY = "CASE event_type WHEN 'click' THEN 'sent' WHEN 'view' THEN 'delivered' WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'failed' ELSE 'queued' END"


@query(
    "ST2_delivery_counters",
    f"""WITH d AS (SELECT user_id AS broadcast_id, {_DELIVERY} AS status, CASE WHEN value > 100 THEN ts END AS replied_at FROM events)
    SELECT broadcast_id, count(*) FILTER (WHERE status = 'sent') AS sent_count, count(*) FILTER (WHERE status IN ('delivered', 'read')) AS delivered_count, count(*) FILTER (WHERE status = 'read') AS read_count,
      count(*) FILTER (WHERE status = 'failed') AS failed_count, count(replied_at) AS replied_count FROM d GROUP BY broadcast_id""",
)
def st2_delivery(spark, folder):
    events = ST.read_stream(spark, "events", folder)
    rows = events.select(
        F.col("user_id").alias("broadcast_id"), F.expr(_DELIVERY).alias("status"), F.when(F.col("value") > 100, F.col("ts")).alias("replied_at")
    )
    return _merged(rows, ST.stream_delivery_counters, "broadcast_id")


@query("ST3_stream_visits", "SELECT user_id AS session_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def st3(spark, folder):
    events = ST.read_stream(spark, "events", folder)
    visits = events.select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("session_id"), "user_id", "event_type", F.col("ts").alias("created_at")
    )
    kept = run.drain(ST.stream_visits(visits, delay="60 days"), "st3")
    return kept.groupBy(F.col("user_id").alias("session_id"), "event_type").agg(F.count("*").alias("n"))


# Watermarks are whole milliseconds.
_WM = "(SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events)"


@query(
    "ST4_stream_stale",
    f"""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(max(ts) FILTER (WHERE event_type <> 'click')) AS l, coalesce(epoch_us(max(ts) FILTER (WHERE event_type = 'click')), 0) AS c FROM events GROUP BY user_id),
    w AS (SELECT *, {_WM} - 900000000 AS wm, greatest(l + 1800000000, c + 300000000) AS r, greatest(l + 10800000000, c + 300000000) AS d FROM a)
    SELECT session_id, 'auto_complete' AS action, make_timestamp(d) AS due_at FROM w WHERE wm >= d UNION ALL SELECT session_id, 'reminder', make_timestamp(r) FROM w WHERE wm >= r AND wm < d""",
)
def st4(spark, folder):
    events = ST.read_stream(spark, "events", folder)
    rows = events.select(F.col("user_id").alias("session_id"), "ts", F.when(F.col("event_type") == "click", "chat").otherwise("session").alias("kind"))
    return run.drain(ST.stream_stale(rows, delay="15 minutes", remind_after=30 * ST.MINUTE, complete_after=3 * ST.HOUR), "st4")


@query(
    "ST5_stream_expiry",
    f"""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(min(ts)) AS s, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS k FROM events GROUP BY user_id)
    SELECT session_id, 'expired' AS action, make_timestamp(s + 86400000000) AS due_at, CAST(floor(100 * k / n + 0.5) AS BIGINT) AS mastery FROM a WHERE {_WM} - 3600000000 >= s + 86400000000""",
)
def st5(spark, folder):
    events = ST.read_stream(spark, "events", folder)
    rows = events.select(F.col("user_id").alias("session_id"), "ts", (F.col("event_type") == "purchase").alias("is_correct"))
    return run.drain(ST.stream_expiry(rows), "st5")


@query(
    "ST6_stream_nudge",
    f"""SELECT event_id AS plan_id, user_id, ts AS plan_at FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'signup' AND c.user_id = p.user_id AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 2 HOUR)
      AND ts + INTERVAL 2 HOUR < (SELECT least(max(ts) FILTER (WHERE event_type = 'purchase'), max(ts) FILTER (WHERE event_type = 'signup')) FROM events) - INTERVAL 1 HOUR""",
)
def st6(spark, folder):
    plans = ST.read_stream(spark, "events", folder).filter("event_type = 'purchase'")
    coaching = ST.read_stream(spark, "events", folder).filter("event_type = 'signup'")
    return run.drain(
        ST.stream_nudge(
            plans.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at")),
            coaching.select("user_id", F.col("ts").alias("created_at")),
        ),
        "st6",
    )


@query(
    "ST7_stream_snapshot",
    over_programme(f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, TIMESTAMP '{AS_OF}' AS last_refreshed FROM videos"),
)
def st7(spark, folder):
    _, t = tables(spark, folder)
    base = run.work_folder(spark, "st7")
    views = {"videos": lambda: A.status_counts(t.videos).select("total", "completed")}
    started = ST.stream_snapshot(
        ST.read_stream(spark, "events", folder), views, f"{base}/snapshots", f"{base}/checkpoint", lambda: AS_OF, lambda report: None, every=None
    )
    started.awaitTermination()
    return S.read_snapshot(spark, f"{base}/snapshots", "videos")


@query(
    "ST7_stream_daily",
    over_programme(f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed
    FROM videos WHERE CAST(created_at AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events) GROUP BY 1"""),
)
def st7_daily(spark, folder):
    """Videos a day, refreshed for the days on which events arrive."""
    _, t = tables(spark, folder)
    base = run.work_folder(spark, "st7d")

    def videos(days):
        day = F.to_date("created_at")
        listed = t.videos.filter(day.isin([F.lit(d).cast("date") for d in days]))
        return listed.groupBy(day.alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"))

    changes = ST.read_stream(spark, "events", folder)
    ST.stream_daily(changes, {"videos": ("day", videos)}, f"{base}/views", f"{base}/checkpoint", lambda: AS_OF, every=None).awaitTermination()
    return S.read_snapshot(spark, f"{base}/views", "videos")


@query(
    "ST8_stream_rate",
    f"SELECT CAST(ts AS DATE) AS date, count(*) AS count FROM events GROUP BY 1 HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= {_MARK} - INTERVAL 1 DAY",
)
def st8(spark, folder):
    return run.drain(ST.stream_rate(ST.read_stream(spark, "events", folder), "ts"), "st8")


@query(
    "ST8_stream_trailing",
    f"""WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), e AS (SELECT d + CAST(i AS INTEGER) AS last_day, n FROM d, range(7) AS r(i))
    SELECT last_day, CAST(sum(n) AS BIGINT) AS count FROM e GROUP BY last_day HAVING CAST(last_day + 1 AS TIMESTAMP) <= {_MARK} - INTERVAL 1 DAY""",
)
def st8_trailing(spark, folder):
    return run.drain(ST.stream_trailing(ST.read_stream(spark, "events", folder), "ts"), "st8t")


# N -----------------------------------------------------------------------------------------------


@query(
    "N1_scalar_functions",
    over_programme("""
    SELECT id, CASE WHEN k = 0 THEN 0.0 ELSE round(floor(value) / k * 100, 2) END AS attendance, CASE WHEN k = 0 THEN 0.0 ELSE round(floor(value) / k * 60, 2) END AS wcpm FROM ev"""),
)
def n1(spark, folder):
    register_functions(spark)
    ev = Programme(spark, folder).ev
    return ev.select(
        "id",
        F.expr("calculate_attendance_percentage(CAST(floor(value) AS INT), k)").alias("attendance"),
        F.expr("calculate_wcpm(CAST(floor(value) AS INT), CAST(k AS DOUBLE))").alias("wcpm"),
    )


@query(
    "N2_table_function",
    over_programme(f"""
    WITH norms AS (SELECT * FROM (VALUES {_WORD_VALUES}) AS t(g, lng, ssn, p, cut)),
    x AS (SELECT id, grade_level, CASE WHEN k < 50 THEN 'ur' ELSE 'en' END AS lng, CAST(floor(wcpm + 0.5) AS BIGINT) AS rate FROM reading),
    m AS (SELECT x.id, x.lng, x.rate, max(cut) FILTER (WHERE p = 25) AS lo, max(cut) FILTER (WHERE p = 75) AS hi, max(p) FILTER (WHERE cut <= rate) AS reached
      FROM x LEFT JOIN norms n ON n.g = grade_level AND n.lng = x.lng AND n.ssn = 'spring' GROUP BY ALL)
    SELECT id, CAST(coalesce(lo, CASE WHEN lng = 'ur' THEN 35 ELSE 50 END) AS INTEGER) AS benchmark_min, CAST(coalesce(hi, CASE WHEN lng = 'ur' THEN 70 ELSE 100 END) AS INTEGER) AS benchmark_max,
      rate >= coalesce(lo, CASE WHEN lng = 'ur' THEN 35 ELSE 50 END) AS on_track, CASE WHEN rate = 0 THEN 1 ELSE coalesce(reached, 10) END AS percentile_rank FROM m"""),
)
def n2(spark, folder):
    register_functions(spark)
    reading = Programme(spark, folder).reading.withColumn("language", F.when(F.col("k") < 50, "ur").otherwise("en"))
    return spark.sql(
        "SELECT r.id, b.* FROM {reading} r, LATERAL check_benchmark_status(r.wcpm, r.grade_level, r.language, true, 'spring') b",
        reading=reading,
    )


@query(
    "N3_named_policies",
    """SELECT o_orderkey AS session_id, CASE WHEN least(CAST(floor(o_totalprice / 125000) AS INTEGER), 3) <= CAST(floor(floor(o_totalprice / 125000) / 2) AS INTEGER) THEN 'I 1' ELSE 'I 2' END AS weakest,
      'I 9' AS last_named FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def n3(spark, folder):
    return _named_policies(spark, folder).filter("framework = 'hots'").drop("framework")


def _named_policies(spark, folder):
    from chalkline.operators import coaching as C
    from chalkline.plans.w_quiz import _framework_docs

    docs = _framework_docs(Programme(spark, folder))
    picked = C.focus_names(docs.withColumn("session_id", F.struct("session_id", "framework")), {"weakest": "weakest", "last_named": lambda items: F.element_at(items, -1)})
    return picked.select("session_id.*", "weakest", "last_named")


@query(
    "N3_policies_all_frameworks",
    f"""WITH {_DOCS}, i AS ({_FOCUS_SQL}) SELECT session_id, framework, arg_min(name, ROW(score / max_score, at_)) AS weakest, arg_max(name, at_) AS last_named
    FROM i JOIN d USING (session_id) GROUP BY ALL""",
)
def n3_all(spark, folder):
    return _named_policies(spark, folder)
