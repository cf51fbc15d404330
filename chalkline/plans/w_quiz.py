"""Registered W, Z, C and R queries."""

from pyspark.sql import functions as F

from chalkline.functions.text import tokenize
from chalkline.operators import coaching as C
from chalkline.operators import quiz as Z
from chalkline.operators import reading as R
from chalkline.operators import windows as W
from chalkline.plans.a_stats import WORDS_SQL
from chalkline.plans.registry import query
from chalkline.plans.standins import ANSWERS, AS_OF, Programme, over_programme, over_quiz


def _gap_sql(minutes):
    return f"""m AS (SELECT *, CASE WHEN lag(created_at) OVER w IS NULL OR created_at - lag(created_at) OVER w > INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END AS n
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)),
    s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM m)"""


@query("W1_sessionize", over_programme(f"WITH {_gap_sql(30)} SELECT id, user_id, created_at, session_no FROM s"))
def w1(spark, folder):
    ev = Programme(spark, folder).ev
    return W.sessionize(ev, "user_id", "created_at", "id", 30).select("id", "user_id", "created_at", "session_no")


@query(
    "W1_sessions_6h",
    over_programme("SELECT user_id, session_no, started_at, ended_at, message_count FROM session_base"),
)
def w1_sessions(spark, folder):
    return W.sessions(W.sessionize(Programme(spark, folder).ev, "user_id", "created_at", "id", 360))


@query(
    "W1_session_totals",
    over_programme("SELECT (SELECT count(*) FROM ev) AS total_conversations, (SELECT count(*) FROM session_base) AS sessions_created, (SELECT count(DISTINCT user_id) FROM ev) AS users_processed"),
)
def w1_totals(spark, folder):
    return W.session_totals(W.sessions(W.sessionize(Programme(spark, folder).ev, "user_id", "created_at", "id", 360)))


def _analysis():
    """Analysis JSON with the score in one of three places, blank or not a number at all."""
    pct = F.floor(F.col("o_totalprice") / 5000).cast("int")
    kind = F.col("o_orderpriority")
    return F.to_json(
        F.struct(
            F.when(kind < "3", "hots").otherwise("oecd").alias("framework"),
            F.struct(
                F.when(kind == "1-URGENT", pct.cast("string")).when(kind == "5-LOW", "n/a").alias("overall_percentage"),
                F.when(kind == "2-HIGH", pct).alias("percentage"),
            ).alias("scores"),
            F.when(kind == "3-MEDIUM", pct.cast("string")).when(kind == "4-NOT SPECIFIED", "").alias("overall_percentage"),
        )
    )


_RECENT = """d AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, CASE WHEN o_orderpriority < '3' THEN 'hots' ELSE 'oecd' END AS framework,
      CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 0.0 WHEN '5-LOW' THEN NULL ELSE CAST(floor(o_totalprice / 5000) AS DOUBLE) END AS pct,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM orders WHERE o_orderstatus <> 'F')"""


def _coaching_orders(p):
    return p.table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        _analysis().alias("analysis_data"),
    )


@query("W2_latest_scores", f"WITH {_RECENT} SELECT * FROM d WHERE newest <= 10 AND pct IS NOT NULL AND id <> 77")
def w2(spark, folder):
    return W.latest_scores(_coaching_orders(Programme(spark, folder)), 10, exclude=77)


@query(
    "W3_top_words_per_key",
    f"""WITH c AS (SELECT source, word, count(*) AS count FROM (SELECT source, unnest({WORDS_SQL.format(t='text')}) AS word FROM documents) GROUP BY source, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY count DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""",
)
def w3(spark, folder):
    return W.top_words_per_key(Programme(spark, folder).table("documents"), "source")


_TOKENS = f"""{ANSWERS}, tokens AS (SELECT session_id, pos, CASE l_returnflag WHEN 'A' THEN ' board' WHEN 'R' THEN ' Look' ELSE ' ok' END AS text,
      pos * 10000 + CAST(floor(l_extendedprice / 10) AS BIGINT) AS start_ms, pos * 10000 + CAST(floor(l_extendedprice / 10) AS BIGINT) + CAST(l_quantity * 100 AS BIGINT) AS end_ms FROM answers)"""


@query(
    "W4_silences",
    f"""WITH {_TOKENS}, g AS (SELECT session_id, pos AS next_pos, lag(end_ms) OVER w AS start_ms, start_ms AS end_ms, start_ms - lag(end_ms) OVER w AS duration_ms,
      trim(coalesce(string_agg(text, '' ORDER BY pos) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')) AS context_before,
      trim(string_agg(text, '' ORDER BY pos) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS context_after
      FROM tokens WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
    k AS (SELECT *, contains(lower(context_before), 'board') AS b, contains(lower(context_after), 'look') AS a FROM g WHERE duration_ms >= 3000)
    SELECT session_id, next_pos, start_ms, end_ms, duration_ms, context_before, context_after,
      CASE WHEN duration_ms <= 5000 THEN 'wait_time' WHEN duration_ms > 15000 THEN 'extended_activity' WHEN a OR b THEN 'board_writing' ELSE 'potential_board_writing' END AS activity,
      CASE WHEN duration_ms <= 5000 THEN 'high' WHEN duration_ms <= 15000 AND a AND b THEN 'high' WHEN a OR b THEN 'medium' ELSE 'low' END AS confidence FROM k""",
)
def w4(spark, folder):
    answers = Programme(spark, folder).answers
    start = F.col("pos") * 10000 + F.floor(F.col("l_extendedprice") / 10)
    tokens = answers.select(
        "session_id",
        "pos",
        F.expr("CASE l_returnflag WHEN 'A' THEN ' board' WHEN 'R' THEN ' Look' ELSE ' ok' END").alias("text"),
        start.alias("start_ms"),
        (start + (F.col("l_quantity") * 100).cast("bigint")).alias("end_ms"),
    )
    return W.silences(tokens)


# Reading pairs: a turn is the passage, the next turn of the conversation the transcript.
def _pairs(p):
    rows = p.table("conversations")
    said = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("transcript_text"))
    return rows.select("conv_id", "turn", F.col("text").alias("passage_text")).join(said, ["conv_id", "turn"]).withColumn(
        "id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )


_TOK = "list_filter(string_split_regex(regexp_replace(lower({t}), '[^\\w\\s\\x{{0600}}-\\x{{06FF}}]', '', 'g'), '\\s+'), lambda w: w <> '')"
_PAIRS = f"""pairs AS (SELECT concat(CAST(a.conv_id AS VARCHAR), '-', CAST(a.turn AS VARCHAR)) AS id, a.text AS p, b.text AS t,
    {_TOK.format(t='a.text')} AS passage, {_TOK.format(t='b.text')} AS words FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query(
    "W5_self_corrections",
    f"""WITH {_PAIRS}, w AS (SELECT id, passage, words, unnest(generate_series(1, len(words) - 1)) AS i FROM pairs)
    SELECT id, words[i] AS incorrect, words[i + 1] AS corrected, CAST(i - 1 AS INTEGER) AS position FROM w
    WHERE NOT list_contains(passage, words[i]) AND list_contains(passage, words[i + 1])""",
)
def w5(spark, folder):
    pairs = _pairs(Programme(spark, folder)).select(
        "id", tokenize(F.col("passage_text")).alias("passage"), tokenize(F.col("transcript_text")).alias("words")
    )
    return W.self_corrections(pairs)


@query(
    "W6_precedes",
    """SELECT * FROM (SELECT p_brand AS book_id, p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS dst FROM part) WHERE dst IS NOT NULL""",
)
def w6(spark, folder):
    lessons = Programme(spark, folder).table("part").select(
        F.col("p_brand").alias("book_id"), F.col("p_size").alias("segment_index"), F.col("p_partkey").alias("lesson_id")
    )
    return W.precedes(lessons)


@query(
    "W7_assign_rolls",
    """WITH s AS (SELECT c_nationkey AS list_id, c_custkey AS position, CASE WHEN c_acctbal > 5000 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS roll FROM customer)
    SELECT list_id, position, CAST(coalesce(roll, max(roll) OVER (PARTITION BY list_id) + sum(CASE WHEN roll IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY list_id ORDER BY position)) AS INTEGER) AS roll_number FROM s""",
)
def w7(spark, folder):
    students = Programme(spark, folder).table("customer").select(
        F.col("c_nationkey").alias("list_id"),
        F.col("c_custkey").alias("position"),
        F.when(F.col("c_acctbal") > 5000, F.floor(F.col("c_acctbal") / 100).cast("int")).alias("roll_number"),
    )
    return W.assign_rolls(students, size=100)


@query(
    "W8_trailing_correct",
    f"""WITH {ANSWERS} SELECT session_id, pos, CASE WHEN pos >= 3 THEN CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) END AS window_correct FROM answers""",
)
def w8(spark, folder):
    return W.trailing_correct(Programme(spark, folder).answers).select("session_id", "pos", "window_correct")


@query(
    "W9_prior_feedback",
    """WITH d AS (SELECT o_orderkey AS id, o_custkey AS user_id, row_number() OVER w - 1 AS prior_count, lag(o_orderkey, 1) OVER w AS l1, lag(o_orderkey, 2) OVER w AS l2,
      lag(o_orderkey, 3) OVER w AS l3 FROM orders WHERE o_orderstatus <> 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT user_id, id, prior_count, prior_count > 3 AS needs_summary, CASE WHEN prior_count <= 3 THEN concat_ws(',', l1, l2, l3) END AS verbatim FROM d""",
)
def w9(spark, folder):
    out = W.prior_feedback(_coaching_orders(Programme(spark, folder)))
    joined = F.array_join(F.transform("verbatim_ids", lambda x: x.cast("string")), ",")
    return out.withColumn("verbatim", joined).drop("verbatim_ids")


@query(
    "W10_dense_index",
    """SELECT s_nationkey AS quiz_id, s_suppkey AS question_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(floor(s_acctbal) AS BIGINT), s_suppkey) AS display_index
    FROM supplier WHERE s_acctbal > 0""",
)
def w10(spark, folder):
    rows = Programme(spark, folder).table("supplier").filter("s_acctbal > 0").select(
        F.col("s_nationkey").alias("quiz_id"), F.col("s_suppkey").alias("question_id"), F.floor("s_acctbal").alias("sort_order")
    )
    return W.dense_index(rows).drop("sort_order")


@query(
    "W11_shelf",
    over_programme(f"""
    WITH r AS (SELECT id, user_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM ev
      WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND created_at <= TIMESTAMP '{AS_OF}')
    SELECT id, user_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS place FROM r WHERE n <= 5"""),
)
def w11(spark, folder):
    return W.shelf(Programme(spark, folder).ev, AS_OF, 5, 240).select("id", "user_id", "created_at", "place")


# Z ----------------------------------------------------------------------------------------------


@query(
    "Z1_session_mastery",
    over_quiz("""
    WITH c AS (SELECT session_id, count(*) AS answered, count(*) FILTER (WHERE is_correct) AS correct FROM answers GROUP BY session_id)
    SELECT *, CAST(floor(correct / answered * 100 + 0.5) AS BIGINT) AS mastery_percentage,
      CASE WHEN correct / answered >= 0.8 THEN 'mastered' WHEN correct / answered >= 0.6 THEN 'developing' ELSE 'needs_practice' END AS mastery_level FROM c"""),
)
def z1(spark, folder):
    return Z.session_mastery(Programme(spark, folder).picks)


_PICKS = """p AS (SELECT r.{key}, a.question_id, selected_option, count(*) AS n, count(*) FILTER (WHERE is_correct) AS r, count(*) FILTER (WHERE NOT is_correct) AS w
      FROM answers a JOIN quiz_runs r ON r.session_id = a.session_id{cond} GROUP BY ALL),
    t AS (SELECT {key}, question_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(r) AS BIGINT) AS correct_count, CAST(sum(w) AS BIGINT) AS wrong_count FROM p GROUP BY ALL)"""
_OPTION = "CASE {l} WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c ELSE {l} END"


@query(
    "Z2_missed_roster",
    over_quiz(f"""
    WITH {_PICKS.format(key='quiz_id', cond=" AND status = 'completed'")},
    b AS (SELECT p.quiz_id, p.question_id, p.selected_option AS letter, n, row_number() OVER (PARTITION BY p.quiz_id, p.question_id ORDER BY n DESC, selected_option) AS rn
      FROM p JOIN questions q ON q.quiz_id = p.quiz_id AND q.question_id = p.question_id AND selected_option <> correct_option),
    x AS (SELECT t.*, q.* EXCLUDE (quiz_id, question_id), letter, n, coalesce(n / (total - correct_count) >= 0.5, false) AS cl, 1.0 - correct_count / total AS miss_rate,
      row_number() OVER (PARTITION BY t.quiz_id ORDER BY 1.0 - correct_count / total DESC, t.question_id) AS place
      FROM t JOIN questions q ON q.quiz_id = t.quiz_id AND q.question_id = t.question_id LEFT JOIN b ON b.quiz_id = t.quiz_id AND b.question_id = t.question_id AND rn = 1 WHERE correct_count < total)
    SELECT quiz_id, place, question_id, question_text, correct_option, {_OPTION.format(l='correct_option')} AS correct_text, total, correct_count, total - correct_count AS wrong_count,
      CASE WHEN cl THEN letter END AS top_wrong_option, CASE WHEN cl THEN {_OPTION.format(l='letter')} END AS top_wrong_text, CASE WHEN cl THEN n ELSE 0 END AS top_wrong_count,
      CASE WHEN cl THEN CASE WHEN noted THEN 'note ' || letter ELSE misconception_feedback END END AS misconception,
      CASE WHEN cl AND noted THEN 'distractor' WHEN cl AND misconception_feedback IS NOT NULL THEN 'question' END AS misconception_source, miss_rate FROM x WHERE place <= 3"""),
)
def z2(spark, folder):
    p = Programme(spark, folder)
    return Z.missed_roster(p.quiz_runs, p.picks, p.questions)


@query(
    "Z3_missed_shared",
    over_quiz(f"""
    WITH {_PICKS.format(key='share_code_id', cond='')},
    b AS (SELECT *, row_number() OVER (PARTITION BY share_code_id, question_id ORDER BY w DESC, selected_option) AS rn,
        lead(w) OVER (PARTITION BY share_code_id, question_id ORDER BY w DESC, selected_option) AS nxt FROM p WHERE w > 0 AND selected_option IS NOT NULL),
    x AS (SELECT t.*, letter, w AS n, coalesce(w / wrong_count >= 0.5 AND w > coalesce(nxt, 0), false) AS cl, wrong_count / total AS miss_rate,
      row_number() OVER (PARTITION BY t.share_code_id ORDER BY wrong_count / total DESC, t.question_id) AS place
      FROM t LEFT JOIN (SELECT *, selected_option AS letter FROM b) b ON b.share_code_id = t.share_code_id AND b.question_id = t.question_id AND rn = 1 WHERE wrong_count > 0 AND total >= 2),
    q AS (SELECT DISTINCT ON (question_id) * FROM (SELECT s_suppkey AS question_id, concat('Question ', CAST(s_suppkey AS VARCHAR)) AS question_text, s_acctbal, concat(s_name, ' a') AS option_a, concat(s_name, ' b') AS option_b, concat(s_name, ' c') AS option_c,
      CASE WHEN s_acctbal < 2000 THEN 'A' WHEN s_acctbal < 6000 THEN 'B' ELSE 'C' END AS correct_option FROM supplier))
    SELECT share_code_id, place, x.question_id, question_text, total, wrong_count, CASE WHEN cl THEN letter END AS top_wrong_option, CASE WHEN cl THEN {_OPTION.format(l='letter')} END AS top_wrong_text,
      CASE WHEN cl THEN n ELSE 0 END AS top_wrong_count, correct_option, {_OPTION.format(l='correct_option')} AS correct_text,
      CASE WHEN cl AND s_acctbal > 3000 THEN CASE letter WHEN 'A' THEN 'first' WHEN 'B' THEN 'second' END END AS misconception, miss_rate FROM x JOIN q ON q.question_id = x.question_id WHERE place <= 3"""),
)
def z3(spark, folder):
    p = Programme(spark, folder)
    return Z.missed_shared(p.quiz_runs, p.picks, p.questions.drop("quiz_id").dropDuplicates(["question_id"]))


@query(
    "Z4_question_audit",
    over_quiz(f"""
    WITH {_PICKS.format(key='quiz_id', cond=" AND status = 'completed'")}
    SELECT t.quiz_id, t.question_id, question_text, correct_option, sort_order, total AS total_attempted, correct_count,
      CAST(coalesce(sum(n) FILTER (WHERE selected_option = 'A'), 0) AS BIGINT) AS picks_a, CAST(coalesce(sum(n) FILTER (WHERE selected_option = 'B'), 0) AS BIGINT) AS picks_b,
      CAST(coalesce(sum(n) FILTER (WHERE selected_option = 'C'), 0) AS BIGINT) AS picks_c, row_number() OVER (PARTITION BY t.quiz_id ORDER BY sort_order, t.question_id) AS display_index,
      CAST(floor(correct_count / total * 100 + 0.5) AS BIGINT) AS percent_correct
    FROM t JOIN questions q ON q.quiz_id = t.quiz_id AND q.question_id = t.question_id JOIN p ON p.quiz_id = t.quiz_id AND p.question_id = t.question_id
    GROUP BY t.quiz_id, t.question_id, question_text, correct_option, sort_order, total, correct_count"""),
)
def z4(spark, folder):
    p = Programme(spark, folder)
    return Z.question_audit(p.quiz_runs, p.picks, p.questions)


_LEVELED = "(SELECT *, CASE WHEN mastery_percentage >= 80 THEN 'mastered' WHEN mastery_percentage >= 60 THEN 'developing' ELSE 'needs_practice' END AS lv FROM quiz_runs)"


@query(
    "Z5_quiz_summary",
    over_quiz(f"""
    WITH c AS (SELECT quiz_id, count(*) AS sent, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status <> 'completed') AS pending,
      CAST(floor(avg(mastery_percentage) FILTER (WHERE status = 'completed') + 0.5) AS BIGINT) AS avg_score, count(*) FILTER (WHERE status = 'completed' AND lv = 'mastered') AS mastered_count,
      count(*) FILTER (WHERE status = 'completed' AND lv = 'developing') AS developing_count, count(*) FILTER (WHERE status = 'completed' AND lv = 'needs_practice') AS needs_practice_count
      FROM {_LEVELED} GROUP BY quiz_id)
    SELECT *, CASE WHEN completed = 0 THEN 'mixed' WHEN avg_score >= 80 AND mastered_count / completed >= 0.7 THEN 'strong' WHEN avg_score < 60 OR mastered_count / completed < 0.3 THEN 'weak' ELSE 'mixed' END AS band FROM c"""),
)
def z5(spark, folder):
    from chalkline.functions.bands import mastery

    return Z.quiz_summary(Programme(spark, folder).quiz_runs.withColumn("mastery_level", mastery(F.col("mastery_percentage"))))


@query(
    "Z5_stragglers",
    over_quiz("SELECT quiz_id, session_id, student_name, mastery_percentage FROM quiz_runs WHERE status = 'completed' AND mastery_percentage < 60"),
)
def z5_stragglers(spark, folder):
    return Z.stragglers(Programme(spark, folder).quiz_runs)


@query(
    "Z5_ranked_results",
    over_quiz("SELECT quiz_id, session_id, student_name, mastery_percentage FROM quiz_runs WHERE status = 'completed'"),
)
def z5_ranked(spark, folder):
    return Z.ranked_results(Programme(spark, folder).quiz_runs)


@query(
    "Z6_replay_adaptive",
    f"""WITH RECURSIVE {ANSWERS}, run(session_id, pos, level, correct, l1, l2, reason) AS (
      SELECT DISTINCT session_id, CAST(0 AS BIGINT), 3, 0, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM answers
      UNION ALL SELECT session_id, pos, level, correct, l1, l2, CASE WHEN pos >= 10 THEN 'max_questions' WHEN pos >= 5 AND level = 5 AND hits = 3 THEN 'mastery' WHEN pos >= 5 AND level = 1 AND hits = 0 THEN 'floor' END
      FROM (SELECT r.session_id, a.pos, CASE WHEN ok + r.l1 + r.l2 = 3 THEN least(5, r.level + 1) WHEN ok + r.l1 + r.l2 <= 1 THEN greatest(1, r.level - 1) ELSE r.level END AS level,
        r.correct + ok AS correct, ok AS l1, r.l1 AS l2, ok + r.l1 + r.l2 AS hits
        FROM run r JOIN (SELECT session_id, pos, CASE WHEN is_correct THEN 1 ELSE 0 END AS ok FROM answers) a ON a.session_id = r.session_id AND a.pos = r.pos + 1 WHERE r.reason IS NULL))
    SELECT session_id, max_by(level, pos) AS final_level, CAST(max(pos) AS INTEGER) AS answered, max_by(correct, pos) AS correct, arg_max_null(reason, pos) AS end_reason FROM run GROUP BY session_id""",
)
def z6(spark, folder):
    return Z.replay_adaptive(Programme(spark, folder).answers)


@query(
    "Z7_valid_questions",
    """WITH g AS (SELECT doc_id, text AS q, lang AS a, source AS b, CASE WHEN n_chars > 300 THEN text ELSE lang END AS c, CASE WHEN n_chars < 1000 THEN 'A' WHEN n_chars < 3000 THEN 'B' ELSE 'D' END AS k,
      CAST(n_chars AS INTEGER) // 250 AS d FROM documents)
    SELECT doc_id, CASE WHEN length(q) > 200 THEN left(q, 197) || '...' ELSE q END AS question_text, a AS option_a, b AS option_b,
      CASE WHEN length(c) > 250 THEN left(c, 247) || '...' ELSE c END AS option_c, k AS correct_option, CASE WHEN d BETWEEN 1 AND 5 THEN d ELSE 3 END AS difficulty_level,
      CASE WHEN length(b) > 0 THEN 'C:' || b || CASE WHEN k = 'A' THEN '|B:' || a ELSE '|A:' || a END END AS notes
    FROM g WHERE q <> '' AND a <> '' AND b <> '' AND c <> '' AND k IN ('A', 'B', 'C') AND a <> b AND b <> c AND a <> c""",
)
def z7(spark, folder):
    docs = Programme(spark, folder).table("documents")
    notes = F.create_map(F.lit("A"), F.col("lang"), F.lit("B"), F.col("lang"), F.lit("C"), F.col("source"))
    questions = docs.select(
        "doc_id",
        F.col("text").alias("question_text"),
        F.col("lang").alias("option_a"),
        F.col("source").alias("option_b"),
        F.when(F.col("n_chars") > 300, F.col("text")).otherwise(F.col("lang")).alias("option_c"),
        F.when(F.col("n_chars") < 1000, "A").when(F.col("n_chars") < 3000, "B").otherwise("D").alias("correct_option"),
        F.floor(F.col("n_chars") / 250).cast("int").alias("difficulty_level"),
        notes.alias("distractor_misconceptions"),
    )
    valid = Z.valid_questions(questions)
    kept = F.col("distractor_misconceptions")
    parts = [F.concat(F.lit(f"{o}:"), kept[o]) for o in ("C", "B", "A")]
    return valid.withColumn("notes", F.when(kept.isNotNull(), F.concat_ws("|", *parts))).drop("distractor_misconceptions")


# C ----------------------------------------------------------------------------------------------


def _framework_docs(p):
    """One analysis document per order in the layout of one of five frameworks."""
    s = F.col("s")
    one, two = F.least(s, F.lit(3)), F.floor(s / 2)

    def ind(ident, score):
        return F.struct(F.lit(ident).alias("id"), F.concat(F.lit("I "), F.lit(ident)).alias("name"), score.alias("score"))

    def element(ident, score):
        return F.struct(F.lit(ident).alias("id"), F.concat(F.lit("I "), F.lit(ident)).alias("name"), score.alias("holistic_score"))

    docs = {
        "hots": F.struct(
            F.struct(
                F.struct(F.array(ind("1", one), ind("2", two)).alias("indicators"), (one + two).alias("area_score")).alias("classroom_environment"),
                F.struct(F.array(ind("9", two)).alias("indicators")).alias("student_engagement"),
            ).alias("areas")
        ),
        "fico": F.struct(
            F.struct(
                F.struct(F.array(ind("2.1", s), ind("2.2", one)).alias("indicators"), (s + one).alias("domain_score"), F.lit(20).alias("domain_max")).alias("instructional_quality")
            ).alias("domains")
        ),
        "teach": F.struct(
            F.struct(one.alias("score")).alias("time_on_task"),
            F.struct(F.struct(F.array(element("1", s), element("2", two)).alias("elements"), (s + two).alias("area_score")).alias("instruction")).alias("areas"),
        ),
        "mewaka": F.struct(
            F.struct(
                F.struct(F.array(ind("A1", s), ind("A2", one)).alias("indicators"), (one * 2).alias("domain_score"), F.lit(6).alias("domain_max")).alias("introduction"),
                F.struct(F.array(ind("F1", two)).alias("indicators")).alias("conclusion"),
            ).alias("domains")
        ),
        "oecd": F.struct(
            F.struct(
                F.struct(one.alias("competency_score"), (one * 3).alias("computed_marks"), F.lit(9).alias("max_marks")).alias("assessment"),
                F.struct(two.alias("competency_score"), (two * 1.5).alias("computed_marks"), F.lit(4).alias("max_marks")).alias("smart_objectives"),
            ).alias("goal1_formative_assessment"),
            F.struct((one * 3 + two).alias("goal1_total"), s.alias("goal4_total")).alias("scores"),
        ),
    }
    json = F.lit(None).cast("string")
    for name, doc in docs.items():
        json = F.when(F.col("framework") == name, F.to_json(doc)).otherwise(json)
    framework = F.expr(
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'hots' WHEN '2-HIGH' THEN 'fico' WHEN '3-MEDIUM' THEN 'teach' WHEN '4-NOT SPECIFIED' THEN 'mewaka' ELSE 'oecd' END"
    )
    base = p.table("orders").select(
        F.col("o_orderkey").alias("session_id"),
        framework.alias("framework"),
        (F.col("o_orderstatus") == "P").alias("has_lesson_plan"),
        F.floor(F.col("o_totalprice") / 125000).cast("int").alias("s"),
    )
    return base.withColumn("analysis_data", json)


_DOCS = """d AS (SELECT o_orderkey AS session_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'hots' WHEN '2-HIGH' THEN 'fico' WHEN '3-MEDIUM' THEN 'teach' WHEN '4-NOT SPECIFIED' THEN 'mewaka' ELSE 'oecd' END AS framework,
      o_orderstatus = 'P' AS plan, CAST(floor(o_totalprice / 125000) AS INTEGER) AS s, least(CAST(floor(o_totalprice / 125000) AS INTEGER), 3) AS one, CAST(floor(floor(o_totalprice / 125000) / 2) AS INTEGER) AS two FROM orders)"""


@query(
    "C1_framework_scores",
    f"""WITH {_DOCS}, r AS (
      SELECT session_id, framework, plan, 'classroom_environment' AS key, 'Classroom Environment' AS name, CAST(one + two AS DOUBLE) AS score, 9.0 AS max, one + 2 * two AS m, 48.0 AS overall_max FROM d WHERE framework = 'hots'
      UNION ALL SELECT session_id, framework, plan, 'student_engagement', 'Student Engagement', two, 9.0, one + 2 * two, 48.0 FROM d WHERE framework = 'hots'
      UNION ALL SELECT session_id, framework, plan, 'instructional_quality', 'Instructional Quality', s + one, 20.0, s + one, 84.0 FROM d WHERE framework = 'fico'
      UNION ALL SELECT session_id, framework, plan, 'instruction', 'Instruction', s + two, 20.0, s + two + one, 50.0 FROM d WHERE framework = 'teach'
      UNION ALL SELECT session_id, framework, plan, 'introduction', 'Introduction', 2 * one, 6.0, 2 * one + two, 75.0 FROM d WHERE framework = 'mewaka'
      UNION ALL SELECT session_id, framework, plan, 'conclusion', 'Conclusion', two, 6.0, 2 * one + two, 75.0 FROM d WHERE framework = 'mewaka'
      UNION ALL SELECT session_id, framework, plan, g.key, g.name, CASE WHEN g.key LIKE 'goal1%' THEN round(one / 3 * 9 + two / 3 * 4, 2) ELSE 0 END, g.max, round(one / 3 * 9 + two / 3 * 4, 2), CASE WHEN plan THEN 117.0 ELSE 103.0 END
        FROM d, (VALUES ('goal1_formative_assessment', 'Formative Assessment & Feedback', 22.0), ('goal2_student_engagement', 'Student Engagement', 22.0), ('goal3_quality_content', 'Quality Subject Content', 34.0),
          ('goal4_classroom_interaction', 'Classroom Interaction', 5.0), ('goal5_classroom_management', 'Classroom Management', 24.0)) AS g(key, name, max) WHERE framework = 'oecd')
    SELECT session_id, framework, key, name, CAST(score AS DOUBLE) AS score, CAST(max AS DOUBLE) AS max, CAST(round(m, 2) AS DOUBLE) AS overall_marks, CAST(overall_max AS DOUBLE) AS overall_max,
      round(CAST(round(m, 2) AS DOUBLE) / CAST(overall_max AS DOUBLE) * 100, 1) AS overall_percentage FROM r""",
)
def c1(spark, folder):
    return C.framework_scores(_framework_docs(Programme(spark, folder)))


def _group_values():
    rows = []
    stored = {
        ("hots", "A1"): ("one + two", 9), ("fico", "D2"): ("s + one", 20), ("teach", "T1"): ("one", 5), ("teach", "T3"): ("s + two", 20),
        ("mewaka", "A"): ("one * 2", 6), ("oecd", "G1"): ("one * 3 + two", 22), ("oecd", "G4"): ("s", 5),
    }
    for name, prefix, start in (("hots", "A", 1), ("fico", "D", 1), ("teach", "T", 2), ("mewaka", "", 0)):
        if name == "teach":
            rows.append((name, "T1", "Time on Task", *stored[(name, "T1")]))
        for i, (_, label, n) in enumerate(C.AREAS[name]):
            code = "ABCDEF"[i] if name == "mewaka" else f"{prefix}{i + start}"
            score, most = stored.get((name, code), ("0", n * C.SCALE[name]))
            rows.append((name, code, label, score, most))
    for goal, (code, label) in C.GOAL_NAMES.items():
        score, most = stored.get(("oecd", code), ("0", sum(c[1] for c in C.GOALS[goal])))
        rows.append(("oecd", code, label, score, most))
    return " UNION ALL ".join(
        f"SELECT session_id, framework, '{code}' AS key, '{label.replace(chr(39), chr(39) * 2)}' AS name, CAST({score} AS DOUBLE) AS score, CAST({most} AS DOUBLE) AS max FROM d WHERE framework = '{name}'"
        for name, code, label, score, most in rows
    )


@query("C2_score_groups", f"WITH {_DOCS}, g AS ({_group_values()}) SELECT *, CAST(floor(score / max * 100 + 0.5) AS INTEGER) AS pct FROM g")
def c2(spark, folder):
    return C.score_groups(_framework_docs(Programme(spark, folder)))


_FOCUS = [
    ("hots", 0, "I 1", "one", 3, "classroom_environment", "1"), ("hots", 1, "I 2", "two", 3, "classroom_environment", "2"), ("hots", 2, "I 9", "two", 3, "student_engagement", "9"),
    ("fico", 0, "I 2.1", "s", 4, "instructional_quality", "2.1"), ("fico", 1, "I 2.2", "one", 4, "instructional_quality", "2.2"),
    ("teach", 0, "I 1", "s", 5, "instruction", "E1"), ("teach", 1, "I 2", "two", 5, "instruction", "E2"),
    ("mewaka", 0, "I A1", "s", 4, "introduction", "A1"), ("mewaka", 1, "I A2", "one", 4, "introduction", "A2"), ("mewaka", 2, "I F1", "two", 4, "conclusion", "F1"),
    ("oecd", 0, "assessment", "one * 3", 9, "goal1_formative_assessment", "assessment"), ("oecd", 1, "smart objectives", "two * 1.5", 4, "goal1_formative_assessment", "smart_objectives"),
]
_FOCUS_SQL = " UNION ALL ".join(
    f"SELECT session_id, {at} AS at_, '{name}' AS name, CAST({score} AS DOUBLE) AS score, CAST({most} AS DOUBLE) AS max_score, '{area}' AS area, '{ident}' AS id FROM d WHERE framework = '{fw}'"
    for fw, at, name, score, most, area, ident in _FOCUS
)


@query(
    "C3_focus_indicator",
    f"""WITH {_DOCS}, i AS ({_FOCUS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score / max_score, at_) AS rn FROM i)
    SELECT session_id, name, score, max_score, area, id FROM r WHERE rn = 1""",
)
def c3(spark, folder):
    return C.focus_indicator(_framework_docs(Programme(spark, folder)), "no such policy")


def _chunks(p):
    return p.answers.select(
        "session_id",
        F.col("pos").alias("chunk_no"),
        F.concat(F.lit("Summary "), F.col("question_id").cast("string")).alias("summary"),
        F.col("l_quantity").cast("bigint").alias("praise_count"),
        F.when(F.col("l_returnflag") == "A", F.col("pos")).alias("redirection_count"),
        F.transform(
            F.sequence(F.lit(1), F.floor(F.col("l_quantity") / 20).cast("int") + 1),
            lambda i: F.concat(F.col("question_id").cast("string"), F.lit("."), i.cast("string")),
        ).alias("sections"),
    )


@query(
    "C4_merge_chunk_metrics",
    f"""WITH {ANSWERS} SELECT session_id, count(*) AS chunks, min_by(concat('Summary ', CAST(question_id AS VARCHAR)), pos) AS summary, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS praise_count,
      CAST(coalesce(sum(pos) FILTER (WHERE l_returnflag = 'A'), 0) AS BIGINT) AS redirection_count FROM answers GROUP BY session_id""",
)
def c4(spark, folder):
    return C.merge_chunk_metrics(_chunks(Programme(spark, folder)), ["praise_count", "redirection_count"])


@query(
    "C4_merge_chunk_lists",
    f"""WITH {ANSWERS}, i AS (SELECT session_id, pos AS chunk_no, question_id, unnest(generate_series(1, CAST(floor(l_quantity / 20) AS INTEGER) + 1)) AS n FROM answers)
    SELECT session_id, chunk_no, row_number() OVER (PARTITION BY session_id ORDER BY chunk_no, n) AS place, concat(CAST(question_id AS VARCHAR), '.', CAST(n AS VARCHAR)) AS item FROM i""",
)
def c4_lists(spark, folder):
    return C.merge_chunk_lists(_chunks(Programme(spark, folder)), "sections")


# R ----------------------------------------------------------------------------------------------


@query("R1_align_words")
def r1(spark, folder):
    pairs = _pairs(Programme(spark, folder)).select(
        "id", tokenize(F.col("passage_text")).alias("passage"), tokenize(F.col("transcript_text")).alias("words")
    )
    return R.align_words(pairs).select(
        "id", *[F.col(f"alignment.{c}").alias(c) for c in ("correct", "omissions", "insertions", "substitutions", "distance")]
    )


@query("R2_fluency_metrics")
def r2(spark, folder):
    pairs = _pairs(Programme(spark, folder))
    stamps = F.when(
        F.col("turn") > 0,
        F.array(
            F.struct(F.lit("a").alias("word"), F.lit(500).cast("bigint").alias("startMs"), F.lit(700).cast("bigint").alias("endMs")),
            F.struct(F.lit("b").alias("word"), F.lit(30000).cast("bigint").alias("startMs"), (F.lit(30500) + F.length("transcript_text") * 10).cast("bigint").alias("endMs")),
        ),
    )
    rows = pairs.withColumns(
        {
            "passage_type": F.lit("sentences"),
            "word_timestamps": stamps,
            "audio_duration_seconds": F.length("passage_text").cast("double"),
        }
    )
    return R.fluency_metrics(rows).withColumn("errors", F.to_json("errors"))


_PLAIN = "string_split_regex(trim(regexp_replace(lower({t}), '[^\\w\\s]', '', 'g'), E' \\n\\t\\r'), '\\s+')"


@query(
    "R3_text_pronunciation",
    f"""WITH {_PAIRS}, w AS (SELECT id, {_PLAIN.format(t='p')} AS r, {_PLAIN.format(t='t')} AS h FROM pairs),
    s AS (SELECT id, CAST(floor(len(list_filter(r, lambda x: list_contains(h, x))) / len(r) * 100 + 0.5) AS INTEGER) AS accuracy_score,
      CAST(floor(greatest(0.0, 100 - abs(len(h) / len(r) - 1) * 100) + 0.5) AS INTEGER) AS fluency_score, CAST(floor(len(h) / len(r) * 100 + 0.5) AS INTEGER) AS completeness_score FROM w)
    SELECT *, CAST(floor((accuracy_score + fluency_score) / 2 + 0.5) AS INTEGER) AS pronunciation_score FROM s""",
)
def r3(spark, folder):
    pairs = _pairs(Programme(spark, folder)).select(
        "id", F.col("passage_text").alias("reference"), F.col("transcript_text").alias("heard")
    )
    return R.text_pronunciation(pairs).drop("reference", "heard")


@query(
    "R4_comprehension_scores",
    f"""WITH {ANSWERS}, c AS (SELECT session_id AS assessment_id, CAST(session_id % 7 AS INTEGER) AS grade_level, count(*) FILTER (WHERE is_correct) AS correct_answers, count(*) AS total_questions FROM answers GROUP BY ALL),
    t AS (SELECT *, CASE WHEN grade_level IN (4, 5) THEN 3 ELSE 2 END AS lo, CASE WHEN grade_level IN (4, 5) THEN 4 ELSE 3 END AS mid, CASE WHEN grade_level IN (3, 4, 5) THEN 5 ELSE 4 END AS hi FROM c)
    SELECT assessment_id, grade_level, correct_answers, total_questions, CAST(floor(correct_answers / total_questions * 100 + 0.5) AS INTEGER) AS score,
      CASE WHEN correct_answers < lo THEN 'urgent_intervention' WHEN correct_answers < mid THEN 'below_benchmark' WHEN correct_answers < hi THEN 'at_benchmark' ELSE 'above_benchmark' END AS status FROM t""",
)
def r4(spark, folder):
    answers = Programme(spark, folder).picks.select(
        F.col("session_id").alias("assessment_id"),
        (F.col("session_id") % 7).cast("int").alias("grade_level"),
        F.col("is_correct").alias("correct"),
    )
    return R.comprehension_scores(answers)
