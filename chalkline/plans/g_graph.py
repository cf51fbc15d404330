"""Registered V, G, E and X queries."""

import math

from pyspark.sql import functions as F

from chalkline.operators import gates as V
from chalkline.operators import graph as G
from chalkline.operators import vectors as E
from chalkline.plans.registry import query
from chalkline.plans.standins import Programme

# Segments: a brand is a book, a part a lesson; the codes are built from size, name and type.
_CODE = "concat(CASE WHEN p_size < 25 THEN 'M' ELSE 'U' END, '-', CASE WHEN p_type = 'PROMO' THEN '02' ELSE '01' END, '-', upper(left(p_name, 2)), '-', lpad(CAST(length(p_name) AS VARCHAR(3)), 2, '0'))"
_CODE2 = "concat('S-01-', upper(right(p_name, 2)), '-', lpad(CAST(length(p_type) AS VARCHAR(3)), 2, '0'), CASE WHEN p_size > 45 THEN ' [DERIVED]' ELSE '' END)"
_BLOOM = "CASE WHEN p_size < 10 THEN 'remember' WHEN p_size < 25 THEN 'Apply' WHEN p_size < 40 THEN 'analyze' ELSE '' END"


def segments(p):
    part = p.table("part")
    return part.select(
        F.concat(F.lit("grade_1_"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("book_id"),
        F.lit("1").alias("grade"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("subject"),
        F.col("p_partkey").alias("position"),
        F.col("p_partkey").alias("segment_index"),
        F.lit("").alias("day_label"),
        (F.col("p_size") / 10).cast("bigint").alias("chapter_number"),
        F.concat(F.lit("Chapter of "), F.col("p_name")).alias("chapter_title"),
        F.col("p_name").alias("topic"),
        F.lower("p_type").alias("skill_type"),
        F.lit(None).cast("string").alias("cpa_phase"),
        F.array(F.col("p_size").cast("bigint")).alias("pages_printed"),
        F.array(F.expr(_CODE.replace("VARCHAR(3)", "STRING")), F.expr(_CODE2.replace("VARCHAR(3)", "STRING")), F.when(F.col("p_size") == 7, "see notes").otherwise(" ")).alias("slo_codes"),
        F.array(F.concat(F.lit("d "), F.col("p_name"))).alias("slo_descriptions"),
        F.expr(_BLOOM).alias("blooms"),
        F.when(F.col("p_size") > 30, "revision").alias("new_or_revision"),
    )


_SEG = f"""seg AS (SELECT concat('grade_1_', lower(replace(p_brand, '#', '_'))) AS book_id, p_partkey AS position, p_name, p_type, p_size, CAST(floor(p_size / 10) AS BIGINT) AS ch,
      concat('grade_1_', lower(replace(p_brand, '#', '_')), '::ch', CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR)) AS chk,
      concat('grade_1_', lower(replace(p_brand, '#', '_')), '::ch', CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR), '::L', CAST(p_partkey AS VARCHAR)) AS lk,
      {_BLOOM} AS bloom, {_CODE} AS c1, {_CODE2} AS c2 FROM part),
    raw AS (SELECT *, 0 AS i, c1 AS raw FROM seg UNION ALL SELECT *, 1, c2 FROM seg UNION ALL SELECT *, 2, 'see notes' FROM seg WHERE p_size = 7),
    oc AS (SELECT *, CASE WHEN raw = 'see notes' THEN raw ELSE split_part(raw, ' [', 1) END AS code, contains(raw, '[DERIVED]') AS fused, raw = 'see notes' AS mal,
      raw <> 'see notes' AND split_part(raw, '-', 2) <> '01' AS sus, CASE WHEN raw = 'see notes' THEN '?' ELSE split_part(raw, '-', 3) END AS strand FROM raw),
    o AS (SELECT *, CASE WHEN sus THEN code || '@' || book_id ELSE code END AS node_id, position * 10000 + i AS place FROM oc)"""


@query(
    "V1_code_drift",
    f"""WITH {_SEG}, l AS (SELECT book_id, code, 'MALFORMED' AS issue FROM o WHERE mal UNION ALL SELECT book_id, code, 'FUSED_ANNOTATION' FROM o WHERE fused UNION ALL SELECT book_id, code, 'GRADE_MISMATCH' FROM o WHERE sus)
    SELECT book_id, issue, count(*) AS occurrences, count(DISTINCT code) AS "distinct" FROM l GROUP BY book_id, issue""",
)
def v1(spark, folder):
    return V.code_drift(V.code_rows(segments(Programme(spark, folder))))


@query(
    "V1_code_registry",
    f"""WITH {_SEG} SELECT code, split_part(code, '-', 2) AS grade, split_part(code, '-', 1) AS subject, strand, count(DISTINCT book_id) AS books FROM o WHERE NOT mal AND NOT fused AND NOT sus GROUP BY ALL""",
)
def v1_registry(spark, folder):
    return V.code_registry(V.code_rows(segments(Programme(spark, folder))))


@query("V1_quarantine", f"WITH {_SEG} SELECT DISTINCT book_id, code FROM o WHERE sus")
def v1_quarantine(spark, folder):
    return V.drift_list(V.code_rows(segments(Programme(spark, folder))), "GRADE_MISMATCH")


@query(
    "V1_drift_status",
    f"""WITH {_SEG} SELECT (SELECT count(DISTINCT code) FROM o WHERE NOT mal AND NOT fused AND NOT sus) AS registry_size, count(*) AS drift_occurrences, CASE WHEN count(*) > 0 THEN 'flagged' ELSE 'clean' END AS status
    FROM o WHERE mal OR fused OR sus""",
)
def v1_status(spark, folder):
    return V.drift_status(V.code_rows(segments(Programme(spark, folder))))


def _lessons(p):
    """A document as a lesson body in the stored JSON shape."""
    d = F.col
    steps = F.array(
        F.struct(F.col("source").alias("title"), F.concat(F.lit("Work 20 min on "), F.col("lang")).alias("text"), F.struct(F.when(d("n_chars") > 900, "What is it?").otherwise("no").alias("question")).alias("cfu")),
        F.struct(F.lit("b").alias("title"), F.when(d("n_chars") > 1500, "then 15 min more").otherwise("then 50 min").alias("text"), F.struct(F.lit("Why is this so?").alias("question")).alias("cfu")),
    )
    problems = F.array(
        F.struct(F.lit("q").alias("question"), F.when(d("n_chars") > 700, "open-personal").alias("status"), F.lit("").alias("solution")),
        F.struct(F.lit("q").alias("question"), F.lit("solved").alias("status"), F.lit("7").alias("solution")),
    )
    body = F.struct(
        d("text").alias("warmUp"),
        F.when(d("lang") == "en", "hook").alias("hookStory"),
        F.when(d("lang") != "fr", F.array(d("lang"))).alias("keyWords"),
        steps.alias("steps"),
        problems.alias("problems"),
        F.when(d("n_chars") > 1200, F.concat(d("source"), F.lit(" exit ticket with a longer question"))).otherwise("short").alias("exitTicket"),
        F.when(d("lang") != "de", "help").alias("weakLearnerSupport"),
        F.lit("more").alias("challengeExtension"),
        F.when(d("lang") == "es", "").otherwise("page 4").alias("homework"),
        F.lit(35).alias("duration_min"),
    )
    rows = p.table("documents").select("doc_id", "lang", "n_chars", F.to_json(body).alias("json"))
    return rows.select(
        F.col("doc_id").alias("lesson_id"),
        F.from_json("json", V.LESSON_BODY).alias("body"),
        F.when(F.col("lang") != "es", F.array(F.lit(3))).alias("pages"),
        F.array(F.when(F.col("lang") == "de", "M-01-NS-02 [DERIVED]").otherwise("M-01-NS-02")).alias("slo_codes"),
        (F.col("n_chars") > 300).alias("has_segment"),
    )


_MIN = "[CAST(x AS INTEGER) FOR x IN regexp_extract_all(f, '([0-9]{1,2})\\s*(?:min|منٹ)', 1)][1:12]"
_QA = f"""d AS (SELECT doc_id, text, lang, source, n_chars, concat_ws(' ', text, CASE WHEN lang = 'en' THEN 'hook' END, CASE WHEN lang <> 'fr' THEN lang END, source, 'Work 20 min on ' || lang, CASE WHEN n_chars > 900 THEN 'What is it?' ELSE 'no' END, 'b',
        CASE WHEN n_chars > 1500 THEN 'then 15 min more' ELSE 'then 50 min' END, 'Why is this so? q', CASE WHEN n_chars > 700 THEN 'open-personal' END, 'q solved 7', CASE WHEN n_chars > 1200 THEN source || ' exit ticket with a longer question' ELSE 'short' END,
        CASE WHEN lang <> 'de' THEN 'help' END, 'more', CASE WHEN lang <> 'es' THEN 'page 4' END, '35.0') AS f, CASE WHEN n_chars > 1200 THEN source || ' exit ticket with a longer question' ELSE 'short' END AS et FROM documents),
    m AS (SELECT *, {_MIN} AS mins FROM d), t AS (SELECT *, list_sum(mins) AS tot FROM m),
    c AS (SELECT doc_id, n_chars > 300 AS seg, unnest([
      {{'c': 'H1', 'h': true, 'p': NOT regexp_matches(f, '(?i)\\bTBD\\b|\\bTODO\\b|\\bXXX\\b') AND NOT regexp_matches(f, '(?i)\\[insert[^\\]]*\\]|\\[add[^\\]]*\\]|\\[fill[^\\]]*\\]') AND NOT regexp_matches(f, '(?i)fill in with students|will be added later')}},
      {{'c': 'H2.warmUp', 'h': true, 'p': length(trim(text)) > 20}}, {{'c': 'H2.steps', 'h': true, 'p': true}}, {{'c': 'H2.exitTicket', 'h': true, 'p': length(et) > 20}}, {{'c': 'H3', 'h': true, 'p': n_chars > 700}},
      {{'c': 'H4', 'h': true, 'p': length(et) > 30}}, {{'c': 'H5', 'h': true, 'p': lang <> 'es'}}, {{'c': 'H6', 'h': true, 'p': true}}, {{'c': 'S1.hookStory', 'h': false, 'p': lang = 'en'}}, {{'c': 'S1.keyWords', 'h': false, 'p': lang <> 'fr'}},
      {{'c': 'S1.boardWork', 'h': false, 'p': false}}, {{'c': 'S1.problems', 'h': false, 'p': true}}, {{'c': 'S1.weakLearnerSupport', 'h': false, 'p': lang <> 'de'}}, {{'c': 'S1.challengeExtension', 'h': false, 'p': true}}, {{'c': 'S1.homework', 'h': false, 'p': lang <> 'es'}},
      {{'c': 'S2', 'h': false, 'p': tot BETWEEN 20 AND 55 OR (list_contains(mins, 35) AND tot - 35 BETWEEN 20 AND 55) OR tot - list_max(mins) BETWEEN 20 AND 55}},
      {{'c': 'S3', 'h': false, 'p': greatest(1 + CASE WHEN n_chars > 900 THEN 1 ELSE 0 END, len(regexp_extract_all(f, '(?i)\\bCFU\\b|check for understanding'))) >= 2}},
      {{'c': 'S4', 'h': false, 'p': lang <> 'de'}}, {{'c': 'S5', 'h': false, 'p': lang <> 'fr'}}, {{'c': 'S6', 'h': false, 'p': lang <> 'de'}}]) AS x FROM t),
    k AS (SELECT doc_id AS lesson_id, x.c AS check_id, x.h AS hard, x.p AS passed FROM c WHERE seg OR x.c NOT IN ('H5', 'H6', 'S6'))"""


@query("V2_qa_checks", f"WITH {_QA} SELECT * FROM k")
def v2(spark, folder):
    return V.qa_checks(_lessons(Programme(spark, folder)))


@query(
    "V2_qa_summary",
    f"WITH {_QA} SELECT lesson_id, bool_and(passed OR NOT hard) AS hard_pass, round_even(100.0 * count(*) FILTER (WHERE passed AND NOT hard) / count(*) FILTER (WHERE NOT hard), 1) AS soft_pct FROM k GROUP BY lesson_id",
)
def v2_summary(spark, folder):
    return V.qa_summary(V.qa_checks(_lessons(Programme(spark, folder))))


_RATE = "CASE WHEN l_quantity <= 1 THEN 1 WHEN l_quantity <= 8 THEN 2 WHEN l_quantity <= 20 THEN 3 WHEN l_quantity <= 45 THEN 4 END"


def _ratings(p):
    return p.table("lineitem").select(
        F.col("l_orderkey").alias("lesson_id"),
        F.when(F.col("l_linenumber") == 1, "1A").otherwise(F.concat(F.lit("C"), F.col("l_linenumber").cast("string"))).alias("check_id"),
        F.expr(_RATE).alias("rating"),
        (F.col("l_tax") == 0.08).alias("not_assessable"),
    )


@query(
    "V3_tally_reviews",
    f"""WITH r AS (SELECT l_orderkey AS lesson_id, {_RATE} AS rating, l_tax = 0.08 AS na FROM lineitem)
    SELECT lesson_id, CAST(coalesce(sum(rating) FILTER (WHERE NOT na), 0) AS BIGINT) AS points, count(rating) FILTER (WHERE NOT na) * 4 AS out_of, count(*) FILTER (WHERE na OR rating IS NULL) AS not_assessable,
      count(*) FILTER (WHERE NOT na AND rating = 1) AS rated_one FROM r GROUP BY lesson_id""",
)
def v3(spark, folder):
    return V.tally_reviews(_ratings(Programme(spark, folder)))


@query(
    "V4_production_gate",
    f"""WITH s AS (SELECT o_orderkey AS lesson_id, o_orderstatus <> 'P' AS qa, floor(o_totalprice / 5000) + 20.0 AS comp, CASE o_orderpriority WHEN '1-URGENT' THEN 'a-sonnet-b' WHEN '2-HIGH' THEN 'luna' ELSE 'base' END AS judge FROM orders),
    l AS (SELECT l_orderkey, count(*) FILTER (WHERE {_RATE} = 1) AS ones, count(*) FILTER (WHERE {_RATE} = 2 AND l_linenumber <> 1) AS twos FROM lineitem GROUP BY l_orderkey),
    b AS (SELECT lesson_id, qa, comp, coalesce(ones, 0) AS ones, coalesce(twos, 0) AS twos, CASE WHEN judge LIKE '%sonnet%' THEN 94.0 WHEN judge LIKE '%luna%' THEN 91.5 ELSE 92.0 END AS bar FROM s LEFT JOIN l ON l_orderkey = lesson_id),
    x AS (SELECT *, concat_ws('; ', CASE WHEN NOT qa THEN 'hard-QA fail' END, CASE WHEN ones > 0 THEN 'checks rated 1' END, CASE WHEN twos > 2 THEN 'too many checks rated 2' END, CASE WHEN comp < bar THEN 'composite below bar' END) AS reasons FROM b)
    SELECT lesson_id, CAST(bar AS DOUBLE) AS bar, ones, twos, reasons, reasons = '' AS passed FROM x""",
)
def v4(spark, folder):
    p = Programme(spark, folder)
    judge = F.when(F.col("o_orderpriority") == "1-URGENT", "a-sonnet-b").when(F.col("o_orderpriority") == "2-HIGH", "luna").otherwise("base")
    scores = p.table("orders").select(
        F.col("o_orderkey").alias("lesson_id"),
        (F.col("o_orderstatus") != "P").alias("qa_hard_pass"),
        (F.floor(F.col("o_totalprice") / 5000) + 20.0).alias("composite_pct"),
        judge.alias("judge"),
    )
    out = V.production_gate(scores, _ratings(p))
    return out.select("lesson_id", "bar", "ones", "twos", F.concat_ws("; ", "reasons").alias("reasons"), "passed")


@query(
    "V5_project_check",
    """WITH pg AS (SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS b, p_size, p_type FROM part), books AS (SELECT DISTINCT concat('grade_1_', b) AS book FROM pg WHERE p_type = 'PROMO')
    SELECT 'page name' AS problem, concat('grade_1_', b, '/pg_', CAST(p_size AS VARCHAR), '.json') AS item FROM pg WHERE p_type = 'PROMO' GROUP BY ALL
    UNION ALL SELECT DISTINCT 'audio without lesson', concat('grade_1_', b, '_ch1_seg', CAST(p_size AS VARCHAR)) FROM pg WHERE p_type = 'SMALL'
      AND concat('grade_1_', b, '_ch1_seg', CAST(p_size AS VARCHAR)) NOT IN (SELECT concat('grade_1_', b, '_ch1_seg', CAST(p_size AS VARCHAR)) FROM pg WHERE p_type = 'MEDIUM')
    UNION ALL SELECT DISTINCT 'segmentation of unknown book', concat('grade_1_', b) FROM pg WHERE p_type = 'ECONOMY' AND concat('grade_1_', b) NOT IN (SELECT book FROM books)
    UNION ALL SELECT DISTINCT 'lesson name', concat('Lesson ', b) FROM pg WHERE p_type = 'ECONOMY'""",
)
def v5(spark, folder):
    part = Programme(spark, folder).table("part").withColumn("b", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))))
    lesson = F.concat(F.lit("grade_1_"), "b", F.lit("_ch1_seg"), F.col("p_size").cast("string"))
    paths = F.when(
        F.col("p_type") == "PROMO", F.array(F.concat(F.lit("01_page_truth/grade_1_"), "b", F.lit("/pg_"), F.col("p_size").cast("string"), F.lit(".json")))
    ).when(F.col("p_type") == "SMALL", F.array(F.concat(F.lit("05_voicenotes/"), lesson, F.lit(".mp3")))).when(
        F.col("p_type") == "MEDIUM", F.array(F.concat(F.lit("04_lesson_plans/"), lesson, F.lit("/_slide_script.json")))
    ).when(
        F.col("p_type") == "ECONOMY",
        F.array(
            F.concat(F.lit("02_segmentation/grade_1_"), "b", F.lit("_full_segments.json")),
            F.concat(F.lit("04_lesson_plans/Lesson "), "b", F.lit("/_design_review.json")),
        ),
    )
    files = part.select(F.explode(paths).alias("path"), F.lit(1).cast("bigint").alias("length"))
    return V.project_problems(files)


# G ------------------------------------------------------------------------------------------


@query(
    "G1_build_nodes",
    f"""WITH {_SEG} SELECT 'Book' AS label, book_id AS id, CAST(count(*) AS VARCHAR) AS p1, 'brand ' || substring(book_id, 15) AS p2 FROM (SELECT book_id FROM seg) GROUP BY book_id
    UNION ALL SELECT 'Chapter', chk, CAST(ch AS VARCHAR), min_by('Chapter of ' || p_name, position) FROM seg GROUP BY chk, ch
    UNION ALL SELECT 'Lesson', lk, p_name, CASE WHEN position = 995 THEN 'assessment' WHEN position = 990 OR p_size > 30 THEN 'revision' ELSE 'content' END FROM seg
    UNION ALL SELECT 'SLO', node_id, min_by(strand, (book_id, place)), min_by(CASE WHEN i = 0 THEN 'd ' || p_name ELSE '' END, (book_id, place)) || CASE WHEN bool_or(sus) THEN '!' ELSE '' END || CASE WHEN bool_or(fused) THEN '+DERIVED' ELSE '' END FROM o GROUP BY node_id
    UNION ALL SELECT DISTINCT 'SkillType', lower(p_type), NULL, NULL FROM seg UNION ALL SELECT DISTINCT 'Bloom', bloom, NULL, NULL FROM seg WHERE bloom <> ''""",
)
def g1(spark, folder):
    nodes = G.build_nodes(segments(Programme(spark, folder)))
    p = F.col("props")
    marks = F.concat(
        p["description"], F.when(p["suspect_grade_mismatch"] == "true", "!").otherwise(""), F.coalesce(F.concat(F.lit("+"), p["derivation_note"]), F.lit(""))
    )
    label = F.col("label")
    return nodes.select(
        "label",
        "id",
        F.when(label == "Book", p["n_lessons"]).when(label == "Chapter", p["number"]).when(label == "Lesson", p["topic"]).when(label == "SLO", p["strand"]).alias("p1"),
        F.when(label == "Book", p["subject"]).when(label == "Chapter", p["title"]).when(label == "Lesson", p["kind"]).when(label == "SLO", marks).alias("p2"),
    )


@query(
    "G2_build_edges",
    f"""WITH {_SEG} SELECT DISTINCT 'Book' AS src_label, book_id AS src, 'CONTAINS' AS rel, 'Chapter' AS dst_label, chk AS dst FROM seg UNION ALL SELECT 'Chapter', chk, 'CONTAINS', 'Lesson', lk FROM seg
    UNION ALL SELECT 'Lesson', lk, 'TEACHES', 'SLO', node_id FROM o UNION ALL SELECT 'Lesson', lk, 'HAS_SKILL', 'SkillType', lower(p_type) FROM seg UNION ALL SELECT 'Lesson', lk, 'AT_BLOOM', 'Bloom', bloom FROM seg WHERE bloom <> ''
    UNION ALL SELECT 'Lesson', lag(lk) OVER (PARTITION BY book_id ORDER BY position) AS s, 'PRECEDES', 'Lesson', lk FROM seg QUALIFY s IS NOT NULL""",
)
def g2(spark, folder):
    return G.build_edges(segments(Programme(spark, folder))).drop("props")


@query(
    "G3_precedes_slo",
    f"""WITH {_SEG}, f AS (SELECT book_id, strand, node_id, min(place) AS place FROM o GROUP BY ALL),
    c AS (SELECT book_id, strand, node_id AS src, lead(node_id) OVER w AS dst, row_number() OVER w - 1 AS "order" FROM f WINDOW w AS (PARTITION BY book_id, strand ORDER BY place, node_id)) SELECT * FROM c WHERE dst IS NOT NULL""",
)
def g3(spark, folder):
    return G.precedes_slo(G.outcome_places(G.outcome_rows(segments(Programme(spark, folder)))))


@query(
    "G4_co_taught",
    f"WITH {_SEG} SELECT DISTINCT x.book_id, x.node_id AS a, y.node_id AS b FROM o x JOIN o y ON x.book_id = y.book_id AND x.position = y.position AND x.node_id < y.node_id",
)
def g4(spark, folder):
    return G.co_taught(G.lesson_codes(G.outcome_rows(segments(Programme(spark, folder)))))


_META = f"""{_SEG}, bl AS (SELECT node_id AS id, bloom, count(*) AS n, min(place) AS fs FROM o WHERE bloom <> '' GROUP BY ALL),
    mj AS (SELECT id, min_by(bloom, (-n, fs, bloom)) AS bloom FROM bl GROUP BY id),
    meta AS (SELECT s.id, grade, strand, suspect, bloom FROM (SELECT node_id AS id, CASE WHEN bool_or(mal) THEN '?' ELSE min(split_part(code, '-', 2)) END AS grade, min(strand) AS strand, bool_or(sus) AS suspect FROM o GROUP BY node_id) s LEFT JOIN mj ON mj.id = s.id)"""


def _meta(p):
    rows = G.outcome_rows(segments(p))
    slos = rows.groupBy(F.col("node_id").alias("id")).agg(
        F.min("code_grade").alias("grade"), F.min("strand").alias("strand"), F.max("suspect").alias("suspect")
    )
    teaches = rows.select(F.col("lesson_key").alias("lesson"), F.col("node_id").alias("id"), (F.col("position") * 10000 + F.col("code_no")).alias("place"))
    blooms = segments(p).withColumns(G._keys()).filter(F.col("blooms") != "").select(F.col("lesson_key").alias("lesson"), F.col("blooms").alias("bloom"))
    return G.slo_meta(slos, teaches, blooms)


@query("G5_slo_meta", f"WITH {_META} SELECT * FROM meta")
def g5(spark, folder):
    return _meta(Programme(spark, folder))


_RANKS = ", ".join(f"('{b}', {i})" for i, b in enumerate(G.BLOOM))


@query(
    "G6_orient_pairs",
    f"""WITH {_META}, prs AS (SELECT DISTINCT x.node_id AS a, y.node_id AS b FROM o x JOIN o y ON x.book_id = y.book_id AND x.position = y.position AND x.node_id < y.node_id),
    r AS (SELECT * FROM (VALUES {_RANKS}) AS t(name, rk)),
    j AS (SELECT p.a, p.b, TRY_CAST(x.grade AS INTEGER) AS ga, TRY_CAST(y.grade AS INTEGER) AS gb, rx.rk AS ra, ry.rk AS rb FROM prs p JOIN meta x ON x.id = p.a JOIN meta y ON y.id = p.b
      LEFT JOIN r rx ON rx.name = lower(trim(x.bloom)) LEFT JOIN r ry ON ry.name = lower(trim(y.bloom)) WHERE NOT x.suspect AND NOT y.suspect AND (x.strand <> y.strand OR x.grade <> y.grade))
    SELECT CASE WHEN coalesce(ga <> gb, false) THEN CASE WHEN ga > gb THEN b ELSE a END WHEN coalesce(ra <> rb, false) AND ra > rb THEN b ELSE a END AS src,
      CASE WHEN coalesce(ga <> gb, false) THEN CASE WHEN ga > gb THEN a ELSE b END WHEN coalesce(ra <> rb, false) AND ra > rb THEN a ELSE b END AS dst,
      CASE WHEN coalesce(ga <> gb, false) THEN 'grade' WHEN coalesce(ra <> rb, false) THEN 'bloom' END AS method FROM j WHERE coalesce(abs(ga - gb) <= 2, true)""",
)
def g6(spark, folder):
    p = Programme(spark, folder)
    pairs = G.co_taught(G.lesson_codes(G.outcome_rows(segments(p)))).select("a", "b").distinct().withColumn("weight", F.lit(1.0))
    return G.orient_pairs(pairs, _meta(p)).drop("weight")


@query(
    "G7_acyclic_core",
    """WITH RECURSIVE f AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
      e AS (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS i FROM f),
      g AS (SELECT 0::BIGINT AS i, list_transform(range(25), lambda n: 1::BIGINT << n::INT) AS reach, NULL::BOOLEAN AS kept
        UNION ALL SELECT e.i, CASE WHEN (g.reach[dst + 1] >> src::INT) & 1 = 1 THEN g.reach ELSE list_transform(g.reach, lambda m: CASE WHEN (m >> src::INT) & 1 = 1 THEN m | g.reach[dst + 1] ELSE m END) END,
          (g.reach[dst + 1] >> src::INT) & 1 = 0 FROM g JOIN e ON e.i = g.i + 1)
    SELECT src, dst, weight, kept FROM e JOIN (SELECT i, kept FROM g) USING (i)""",
)
def g7(spark, folder):
    """Customers of one nation linked to the supplier's nation: a small dense graph with cycles."""
    p = Programme(spark, folder)
    flows = (
        p.table("lineitem")
        .join(p.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(p.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(p.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
        .agg(F.sum("l_quantity").alias("weight"))
    )
    return G.acyclic_core(flows)


@query(
    "G7_ring_cuts",
    """WITH e AS (SELECT c_custkey AS src, CASE WHEN c_custkey % 3 = 2 OR c_custkey = (SELECT max(c_custkey) FROM customer) THEN c_custkey - c_custkey % 3 ELSE c_custkey + 1 END AS dst,
        CAST(c_acctbal AS DOUBLE) AS weight, c_custkey // 3 AS ring FROM customer)
    SELECT src, dst, weight, row_number() OVER (PARTITION BY ring ORDER BY weight DESC, src, dst) < count(*) OVER (PARTITION BY ring) AS kept FROM e""",
)
def g7_rings(spark, folder):
    """Customers in rings of three (the last ring may be shorter), weighted by balance: each ring loses its lightest edge."""
    customers = Programme(spark, folder).table("customer")
    last = customers.agg(F.max("c_custkey").alias("last"))
    place = F.pmod(F.col("c_custkey"), F.lit(3))
    turn = (place == 2) | (F.col("c_custkey") == F.col("last"))
    rings = customers.crossJoin(F.broadcast(last)).select(
        F.col("c_custkey").alias("src"),
        F.when(turn, F.col("c_custkey") - place).otherwise(F.col("c_custkey") + 1).alias("dst"),
        F.col("c_acctbal").cast("double").alias("weight"),
    )
    return G.acyclic_core(rings)


@query(
    "G7_mixed_rings",
    """WITH e AS (SELECT o_orderkey, o_totalprice::DOUBLE AS weight, o_orderkey % 20 AS p FROM orders),
      r AS (SELECT *, CASE WHEN p < 2 THEN 2 WHEN p < 5 THEN 3 WHEN p < 9 THEN 4 WHEN p < 14 THEN 5 ELSE 6 END AS n FROM e),
      h AS (SELECT o_orderkey AS src, weight, n, o_orderkey - p + CASE n WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 5 WHEN 5 THEN 9 ELSE 14 END AS head FROM r)
    SELECT src, CASE WHEN src = head + n - 1 THEN head ELSE src + 1 END AS dst, weight,
      count(*) OVER ring < n OR row_number() OVER (PARTITION BY head ORDER BY weight DESC, src) < n AS kept FROM h WINDOW ring AS (PARTITION BY head)""",
)
def g7_mixed(spark, folder):
    """Orders in rings of two to six by their numbers, weighted by price: a ring loses its lightest edge, one with a gap none."""
    orders = Programme(spark, folder).table("orders")
    p = F.pmod(F.col("o_orderkey"), F.lit(20))
    size = F.when(p < 2, 2).when(p < 5, 3).when(p < 9, 4).when(p < 14, 5).otherwise(6)
    head = F.col("o_orderkey") - p + F.when(p < 2, 0).when(p < 5, 2).when(p < 9, 5).when(p < 14, 9).otherwise(14)
    rings = orders.select(
        F.col("o_orderkey").alias("src"),
        F.when(F.col("o_orderkey") == head + size - 1, head).otherwise(F.col("o_orderkey") + 1).alias("dst"),
        F.col("o_totalprice").cast("double").alias("weight"),
    )
    return G.acyclic_core(rings)


# E, X ------------------------------------------------------------------------------------------

_QUERY = [math.cos(i) for i in range(64)]
_QUERY_SQL = "[cos(i) FOR i IN range(64)]"


def _dot(a, b):
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(
    "E1_vector_search",
    f"""WITH s AS (SELECT vec_id AS id, label, {_dot('embedding', _QUERY_SQL)} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot(_QUERY_SQL, _QUERY_SQL)})) AS score FROM embeddings WHERE label <> 3)
    SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.05 ORDER BY s.score DESC, id LIMIT 10""",
)
def e1(spark, folder):
    chunks = Programme(spark, folder).table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").filter("label <> 3")
    return E.vector_search(chunks, _QUERY, 10, 0.05).select("id", F.round("score", 6).alias("score"))


@query(
    "E1_store_stats",
    """WITH c AS (SELECT vec_id AS id, label AS repo_key, 1 AS indexed_at FROM embeddings UNION ALL SELECT vec_id, label + 1, 2 FROM embeddings WHERE label < 2),
    l AS (SELECT id, max_by(repo_key, indexed_at) AS repo_key FROM c GROUP BY id) SELECT CAST(repo_key AS VARCHAR) AS repo_key, count(*) AS chunks FROM l WHERE repo_key <> 4 GROUP BY repo_key""",
)
def e1_stats(spark, folder):
    rows = Programme(spark, folder).table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("repo_key"), F.lit(1).alias("indexed_at"))
    changed = rows.filter("repo_key < 2").withColumns({"repo_key": F.col("repo_key") + 1, "indexed_at": F.lit(2)})
    store = E.upsert(rows, changed).withColumn("repo_key", F.col("repo_key").cast("string"))
    return E.store_stats(E.delete_chunks(store, "4"))


_PAIRS = f"""u AS (SELECT vec_id AS id, label, [x / sqrt({_dot('embedding', 'embedding')}) FOR x IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings),
    a AS (SELECT x.id, y.id AS other, round(list_dot_product(x.v, y.v), 9) AS c FROM u x, u y WHERE x.id <> y.id)"""


def _mutual(k, thr):
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rn FROM a),
    m AS (SELECT x.id AS a, x.other AS b, x.c AS cosine FROM n x JOIN n y ON y.id = x.other AND y.other = x.id WHERE x.rn <= {k} AND y.rn <= {k} AND x.c >= {thr} AND x.id < x.other)"""


def _vectors(p):
    return p.table("embeddings").withColumnRenamed("vec_id", "id")


@query("E2_mutual_knn", f"WITH {_PAIRS}, {_mutual(15, 0.5)} SELECT a, b, round(cosine, 6) AS cosine FROM m")
def e2(spark, folder):
    return E.mutual_knn(_vectors(Programme(spark, folder)), 15, 0.5).withColumn("cosine", F.round("cosine", 6))


@query("E2_mutual_knn_wide", f"WITH {_PAIRS}, {_mutual(15, 0.3)} SELECT a, b, round(cosine, 6) AS cosine FROM m")
def e2_wide(spark, folder):
    """Many vectors with more than 15 neighbours above the threshold."""
    return E.mutual_knn(_vectors(Programme(spark, folder)), 15, 0.3).withColumn("cosine", F.round("cosine", 6))


@query(
    "E3_reciprocal_best",
    f"WITH {_PAIRS}, {_mutual(1, 0.4)} SELECT a, b, round(cosine, 6) AS cosine, x.label <> y.label AS cross_script FROM m JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b",
)
def e3(spark, folder):
    vectors = _vectors(Programme(spark, folder))
    scripts = vectors.select("id", F.col("label").alias("script"))
    return E.reciprocal_best(vectors, 0.4, scripts).withColumn("cosine", F.round("cosine", 6))


@query(
    "E4_cosine_profile",
    f"""WITH {_PAIRS}, h AS (SELECT round(c, 6) AS c FROM a WHERE id < other)
    SELECT count(*) AS pairs, round(min(c), 5) AS "min", round(quantile_cont(c, 0.5), 5) AS median, round(quantile_cont(c, 0.95), 5) AS p95, round(max(c), 5) AS "max" FROM h""",
)
def e4(spark, folder):
    out = E.cosine_profile(_vectors(Programme(spark, folder)))
    return out.select("pairs", *[F.round(c, 5).alias(c) for c in ("min", "median", "p95", "max")])


@query(
    "X1_weighted_search",
    """WITH t AS (SELECT p_partkey AS id, 1.0 AS w, lower(p_type) AS token FROM part UNION ALL SELECT p_partkey, 0.4, unnest(list_distinct(string_split_regex(lower(p_name), '[^\\w]+'))) FROM part
      UNION ALL SELECT p_partkey, 0.2, unnest(list_distinct(list_filter(string_split_regex(lower(p_brand), '[^\\w]+'), lambda x: x <> ''))) FROM part)
    SELECT id, round(sum(w), 6) AS score, count(DISTINCT token) AS words FROM t WHERE token IN ('small', 'red', 'brand', '17') GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
def x1(spark, folder):
    catalog = Programme(spark, folder).table("part").withColumnRenamed("p_partkey", "id")
    index = E.weighted_index(catalog, {"p_type": "A", "p_name": "B", "p_brand": "C"})
    return E.weighted_search(index, "Small RED, Brand#17")
