"""V: quality gates over curriculum tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.codes import grade_code, parse_code, validate_code
from chalkline.functions.maths import half_even
from chalkline.functions.rows import explode_into, inline_into

# V1 -----------------------------------------------------------------------------


def code_rows(segments: DataFrame) -> DataFrame:
    """V1: one row per outcome code of a segment with its parts and issues.
    ``segments(book_id, grade, slo_codes, ...)``."""
    raw = explode_into(segments, ["book_id", "grade"], F.col("slo_codes"), "raw")
    raw = raw.withColumn("raw", F.trim("raw")).filter(F.col("raw") != "")
    return raw.withColumns(
        {"c": parse_code(F.col("raw")), "issues": validate_code(F.col("raw"), F.col("grade"))}
    ).select("book_id", grade_code(F.col("grade")).alias("book_grade"), "raw", "c.*", "issues")


def code_registry(codes: DataFrame) -> DataFrame:
    """V1: clean codes with the number of books that use them."""
    clean = codes.filter(F.size("issues") == 0).select("code", "grade", "subject", "strand", "book_id").distinct()
    return clean.groupBy("code").agg(
        F.first("grade").alias("grade"),
        F.first("subject").alias("subject"),
        F.first("strand").alias("strand"),
        F.count("*").alias("books"),
    )


def code_drift(codes: DataFrame) -> DataFrame:
    """V1: per book and issue the occurrences and distinct codes."""
    long = explode_into(codes, ["book_id", "code"], F.col("issues"), "issue")
    per_code = long.groupBy("book_id", "issue", "code").agg(F.count("*").alias("n"))
    return per_code.groupBy("book_id", "issue").agg(F.sum("n").alias("occurrences"), F.count("*").alias("distinct"))


def drift_list(codes: DataFrame, issue: str) -> DataFrame:
    """V1: (book, code) pairs with an issue: GRADE_MISMATCH is the quarantine list, FUSED_ANNOTATION
    the list that can be repaired without an author."""
    return codes.filter(F.array_contains("issues", issue)).select("book_id", "code").distinct()


def drift_status(codes: DataFrame) -> DataFrame:
    """V1: one row: clean or flagged. Drift never fails a run."""
    per_code = codes.groupBy("code").agg(
        F.count_if(F.size("issues") > 0).alias("drift"), F.max(F.size("issues") == 0).alias("clean")
    )
    return per_code.agg(
        F.count_if("clean").alias("registry_size"), F.coalesce(F.sum("drift"), F.lit(0)).alias("drift_occurrences")
    ).withColumn("status", F.when(F.col("drift_occurrences") > 0, "flagged").otherwise("clean"))


# V2 -------------------------------------------------------------------------------

LESSON_BODY = (
    "struct<warmUp:string,hookStory:string,keyWords:array<string>,boardWork:string,"
    "steps:array<struct<title:string,text:string,cfu:struct<question:string,answer:string>>>,"
    "problems:array<struct<question:string,status:string,solution:string,answer:string,answer_key:string>>,"
    "exitTicket:string,weakLearnerSupport:string,challengeExtension:string,homework:string,duration_min:double>"
)

# Patterns that mark unfinished text, and the fields of a lesson.
PLACEHOLDERS = [
    r"(?i)\bTBD\b|\bTODO\b|\bXXX\b",
    r"(?i)\[insert[^\]]*\]|\[add[^\]]*\]|\[fill[^\]]*\]",
    r"(?i)fill in with students|will be added later|to be decided(?!\s+(together|as a class|by the class|with the class|by students))",
    r"(?i)\bOption A\b(?!.*\bOption B\b)",
]
EXPECTED = ["hookStory", "keyWords", "boardWork", "problems", "weakLearnerSupport", "challengeExtension", "homework"]
MINUTES = "(\\d{1,2})\\s*(?:min|منٹ)"
CHECK_WORDS = r"(?i)\bCFU\b|check for understanding|سمجھ کی جانچ"


def body_text(b: Column) -> Column:
    """All text of a lesson body, fields in order, joined by blanks."""

    def listed(items: Column, fields: list[str]) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(" ", *[x[f] for f in fields])), " ")

    steps = F.array_join(
        F.transform(b["steps"], lambda s: F.concat_ws(" ", s["title"], s["text"], s["cfu"]["question"], s["cfu"]["answer"])), " "
    )
    return F.concat_ws(
        " ",
        b["warmUp"],
        b["hookStory"],
        F.array_join(b["keyWords"], " "),
        b["boardWork"],
        steps,
        listed(b["problems"], ["question", "status", "solution", "answer", "answer_key"]),
        b["exitTicket"],
        b["weakLearnerSupport"],
        b["challengeExtension"],
        b["homework"],
        b["duration_min"].cast("string"),
    )


def _present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def qa_checks(lessons: DataFrame) -> DataFrame:
    """V2: one row per lesson and check (``check_id``, ``hard``, ``passed``).

    ``lessons(lesson_id, body struct, pages array, slo_codes array, has_segment boolean)``; the
    segment checks H5, H6 and S6 exist only for lessons with a segment."""
    b = F.col("body")
    full = F.col("_full")
    step_text = F.array_join(F.transform(b["steps"], lambda s: F.concat_ws(" ", s["title"], s["text"], s["cfu"]["question"])), " ")

    def rich(text: Column, least: int) -> Column:
        return F.length(F.trim(F.coalesce(text, F.lit("")))) > least

    clean = F.lit(True)
    for pattern in PLACEHOLDERS:
        clean = clean & ~full.rlike(pattern)
    closed = F.filter(b["problems"], lambda p: F.coalesce(p["status"], F.lit("solved")) != "open-personal")
    unsolved = F.exists(
        F.coalesce(closed, F.array().cast("array<struct<question:string,status:string,solution:string,answer:string,answer_key:string>>")),
        lambda p: F.trim(
            F.coalesce(F.nullif(p["solution"], F.lit("")), F.nullif(p["answer"], F.lit("")), p["answer_key"], F.lit(""))
        )
        == "",
    )
    minutes = F.col("_minutes")
    total = F.aggregate(minutes, F.lit(0), lambda acc, m: acc + m)
    plausible = (
        (F.size(minutes) == 0)
        | total.between(20, 55)
        | (
            F.coalesce(F.array_contains(minutes, b["duration_min"].cast("int")), F.lit(False))
            & F.coalesce((total - b["duration_min"]).between(20, 55), F.lit(False))
        )
        | (total - F.array_max(minutes)).between(20, 55)
    )
    asked = F.size(
        F.filter(F.coalesce(b["steps"]["cfu"]["question"], F.array().cast("array<string>")), lambda q: F.length(F.trim(q)) > 5)
    )
    enough = F.greatest(asked, F.regexp_count(full, F.lit(CHECK_WORDS))) >= 2
    fields = {
        "keyWords": F.size(F.coalesce(b["keyWords"], F.array().cast("array<string>"))) > 0,
        "problems": F.coalesce(F.size(b["problems"]), F.lit(0)) > 0,
    }
    malformed = F.exists(
        F.coalesce("slo_codes", F.array().cast("array<string>")),
        lambda c: (F.trim(c) != "") & F.arrays_overlap(validate_code(c), F.array(F.lit("MALFORMED"), F.lit("FUSED_ANNOTATION"))),
    )
    checks: list[tuple[str, bool, Column]] = [
        ("H1", True, clean),
        ("H2.warmUp", True, rich(b["warmUp"], 20)),
        ("H2.steps", True, rich(step_text, 20)),
        ("H2.exitTicket", True, rich(b["exitTicket"], 20)),
        ("H3", True, ~unsolved),
        ("H4", True, rich(b["exitTicket"], 30)),
        ("H5", True, F.when(F.col("has_segment"), F.coalesce(F.size("pages"), F.lit(0)) > 0)),
        ("H6", True, F.when(F.col("has_segment"), F.coalesce(F.size("slo_codes"), F.lit(0)) > 0)),
        *[(f"S1.{f}", False, fields[f] if f in fields else _present(b[f])) for f in EXPECTED],
        ("S2", False, plausible),
        ("S3", False, enough),
        ("S4", False, _present(b["weakLearnerSupport"]) & _present(b["challengeExtension"])),
        ("S5", False, fields["keyWords"]),
        ("S6", False, F.when(F.col("has_segment"), ~malformed)),
    ]
    prepared = lessons.withColumn("_full", body_text(b)).withColumn(
        "_minutes",
        F.slice(F.transform(F.regexp_extract_all("_full", F.lit(MINUTES), F.lit(1)), lambda m: m.cast("int")), 1, 12),
    )
    flagged = prepared.select("lesson_id", *[ok.alias(f"_{i}") for i, (_, _, ok) in enumerate(checks)])
    cells = [
        F.struct(F.lit(cid).alias("check_id"), F.lit(hard).alias("hard"), F.col(f"_{i}").alias("passed"))
        for i, (cid, hard, _) in enumerate(checks)
    ]
    return flagged.select("lesson_id", F.inline(F.array(*cells))).filter(F.col("passed").isNotNull())


def qa_summary(checks: DataFrame) -> DataFrame:
    """V2: hard pass and soft percentage (half to even) per lesson."""
    soft = ~F.col("hard")
    return checks.groupBy("lesson_id").agg(
        F.min(~F.col("hard") | F.col("passed")).alias("hard_pass"),
        half_even(F.lit(100.0) * F.count_if(soft & F.col("passed")) / F.count_if(soft), 1).alias("soft_pct"),
    )


# V3, V4 ---------------------------------------------------------------------------------

# Composite bar by judge, the check whose twos are tolerated, and how many others are.
BARS = {"sonnet": 94.0, "luna": 91.5}
BAR = 92.0
STRICT_CHECKS = ["1A"]
MAX_TWOS = 2


def tally_reviews(ratings: DataFrame) -> DataFrame:
    """V3: ``ratings(lesson_id, check_id, rating, not_assessable)`` to the points, four times the
    assessable checks and the numbers of flags."""
    skipped = F.col("rating").isNull() | F.coalesce("not_assessable", F.lit(False))
    return ratings.groupBy("lesson_id").agg(
        F.coalesce(F.sum(F.when(~skipped, F.col("rating"))), F.lit(0)).alias("points"),
        (F.count_if(~skipped) * 4).alias("out_of"),
        F.count_if(skipped).alias("not_assessable"),
        F.count_if(~skipped & (F.col("rating") == 1)).alias("rated_one"),
    )


def production_gate(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """V4: ``scores(lesson_id, qa_hard_pass, composite_pct, judge)`` with the pass flag and the reasons."""
    low = ratings.groupBy("lesson_id").agg(
        F.count_if(F.col("rating") <= 1).alias("ones"),
        F.count_if((F.col("rating") > 1) & (F.col("rating") <= 2) & ~F.col("check_id").isin(STRICT_CHECKS)).alias("twos"),
    )
    judge = F.coalesce("judge", F.lit(""))
    bar = F.lit(BAR)
    for name, value in reversed(list(BARS.items())):
        bar = F.when(F.contains(judge, F.lit(name)), value).otherwise(bar)
    joined = scores.join(low, "lesson_id", "left").fillna(0, ["ones", "twos"]).withColumn("bar", bar)
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce("qa_hard_pass", F.lit(False)), "hard-QA fail"),
            F.when(F.col("ones") > 0, "checks rated 1"),
            F.when(F.col("twos") > MAX_TWOS, "too many checks rated 2"),
            F.when(F.coalesce("composite_pct", F.lit(0.0)) < F.col("bar"), "composite below bar"),
        )
    )
    return joined.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


# V5 -----------------------------------------------------------------------------------------

# Name patterns of books, lessons and pages.
BOOK = r"^grade_\d+_[a-z0-9_]+$"
LESSON = r"^grade_\d+_[a-z0-9_]+_ch\d+_seg\d+$"
PAGE = r"^pg_\d{3}\.json$"


def project_problems(files: DataFrame) -> DataFrame:
    """V5: (problem, item) rows over ``files(path)`` relative to the project:
    names that break the folder contract, books without pages, outputs of unknown books, audio without
    a lesson, and lessons with two audio formats.

    Every path says what it is evidence for, as (problem, item, against or in favour); one aggregation
    keeps the items with evidence against them and none in favour."""
    parts = F.split("path", "/")
    named = files.select(
        F.get(parts, F.lit(0)).alias("top"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).alias("folder"),
        F.element_at(parts, -1).alias("name"),
    )
    name, folder = F.col("name"), F.col("folder")
    inside = F.concat_ws("/", folder, name)
    page = (F.col("top") == "01_page_truth") & folder.isNotNull()
    is_page = name.rlike(r"^pg_.*\.json$")
    segments = (F.col("top") == "02_segmentation") & name.endswith("_full_segments.json")
    segmented = F.regexp_replace(name, r"_full_segments\.json$", "")
    enriched = (F.col("top") == "03_enrichment") & folder.isNotNull()
    lesson = (F.col("top") == "04_lesson_plans") & folder.isNotNull()
    audio = (F.col("top") == "05_voicenotes") & name.rlike(r"\.(mp3|ogg)$")
    spoken = F.regexp_replace(name, r"\.(mp3|ogg)$", "")
    body = enriched & name.endswith(".json")

    def says(when: Column, problem: str, item: Column, against: Column | bool) -> Column:
        verdict = F.lit(against) if isinstance(against, bool) else against
        return F.when(when, F.struct(F.lit(problem).alias("problem"), item.alias("item"), verdict.alias("against")))

    evidence = F.array_compact(
        F.array(
            says(page, "book name", folder, ~folder.rlike(BOOK)),
            says(page & is_page, "page name", inside, ~name.rlike(PAGE)),
            says(page, "book without pages", folder, True),
            says(page & is_page, "book without pages", folder, False),
            says(page, "segmentation of unknown book", folder, False),
            says(segments, "segmentation of unknown book", segmented, True),
            says(page, "enrichment of unknown book", folder, False),
            says(enriched, "enrichment of unknown book", folder, True),
            says(body, "lesson body name", inside, ~F.regexp_replace(name, r"\.json$", "").rlike(LESSON)),
            says(lesson, "lesson name", folder, ~folder.rlike(LESSON)),
            says(lesson, "audio without lesson", folder, False),
            says(audio & name.endswith(".mp3"), "audio without lesson", spoken, True),
        )
    )
    judged = inline_into(named, [], evidence, "problem").groupBy("problem", "item").agg(F.min("against").alias("bad"))
    formats = named.filter(audio).groupBy(spoken.alias("item")).agg(F.count_distinct(F.right(name, F.lit(3))).alias("n"))
    return (
        judged.filter("bad")
        .select("problem", "item")
        .unionByName(formats.filter("n > 1").select(F.lit("two audio formats").alias("problem"), "item"))
    )


def project_stats(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """V5: produced files per kind, stamped ledger lines, stamp coverage in percent, and whether it is
    below 90 % of what was produced."""

    def kind(pattern: str) -> Column:
        return F.count_if(F.col("path").rlike(pattern))

    counts = files.agg(
        kind(r"^01_page_truth/[^/]+/pg_[^/]*\.json$").alias("pages"),
        kind(r"^03_enrichment/[^/]+/[^/]+\.json$").alias("enriched"),
        kind(r"^04_lesson_plans/[^/]+/_slide_script\.json$").alias("authored"),
        kind(r"^04_lesson_plans/[^/]+\.pdf$").alias("rendered"),
        kind(r"^04_lesson_plans/[^/]+/_pedagogy_review\.json$").alias("ped"),
        kind(r"^04_lesson_plans/[^/]+/_design_review\.json$").alias("des"),
        kind(r"^05_voicenotes/[^/]+\.mp3$").alias("voicenotes"),
    )
    stamped = ledger.agg(F.count_if(~F.col("malformed")).alias("stamped"), F.count_if("malformed").alias("malformed_lines"))
    produced = sum((F.col(c) for c in ("pages", "authored", "rendered", "ped", "des", "voicenotes")), F.lit(0))
    row = counts.crossJoin(F.broadcast(stamped)).withColumn("produced", produced)  # one row each
    return row.withColumns(
        {
            "stamp_coverage": half_even(F.when(F.col("produced") > 0, F.lit(100.0) * F.col("stamped") / F.col("produced"))),
            "low_coverage": (F.col("produced") > 0) & (F.col("stamped") < F.col("produced") * 0.9),
        }
    )
