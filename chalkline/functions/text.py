"""Transcripts, languages, phrases and JSON picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.rows import posexplode_into
from chalkline.functions.spaces import EDGES, SPACE, SPACE_CHARS

ARABIC_BLOCK = "\\u0600-\\u06FF"

# Blocks of the Arabic script.
ARABIC_SCRIPT = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
# Indic blocks and the language they stand for, in order of checking.
INDIC_BLOCKS = [
    ("hi", "[\\u0900-\\u097F]"),
    ("bn", "[\\u0980-\\u09FF]"),
    ("ta-IN", "[\\u0B80-\\u0BFF]"),
    ("te", "[\\u0C00-\\u0C7F]"),
    ("kn", "[\\u0C80-\\u0CFF]"),
]
SPANISH_LETTERS = "[áéíóúñ¿¡ÁÉÍÓÚÑ]"
# Common words that tell Arabic and Urdu apart.
ARABIC_WORDS = ["اللغة", "العربية", "الله", "من", "في", "إلى", "على", "هذا", "ذلك", "التي", "الذي"]
URDU_WORDS = ["ہے", "ہیں", "میں", "کی", "کے", "کا", "نے", "سے", "اور", "یہ", "وہ", "کیا"]

# Phrases that point to a feature.
FEATURE_PHRASES = {
    "reading": {
        "high": [
            "reading test", "reading assessment", "fluency test", "fluency assessment", "pronunciation test",
            "wcpm", "words per minute", "reading fluency", "assess reading", "test reading", "reading level",
            "oral reading",
        ],
        "medium": [
            "test students reading", "check reading", "reading ability", "students read", "how well they read",
            "reading skills",
        ],
    },
    "coaching": {
        "high": [
            "classroom observation", "classroom recording", "teaching feedback", "analyze my class",
            "analyze my teaching", "coaching session", "observe my class", "review my teaching",
            "audio recording of class",
        ],
        "medium": [
            "teaching tips", "improve teaching", "feedback on lesson", "how did i teach", "teaching analysis",
            "classroom audio",
        ],
    },
    "lesson_plan": {
        "high": [
            "lesson plan", "create lesson", "make a lesson plan", "generate lesson", "plan a lesson",
            "teaching plan", "class plan",
        ],
        "medium": ["prepare lesson", "plan for tomorrow", "teaching tomorrow", "what to teach", "how to teach"],
    },
}


def clean_transcript(text: Column) -> Column:
    """F8: drop [mm:ss] marks, speaker labels with a language and stand-alone language codes."""
    out = F.coalesce(text, F.lit(""))
    start, end = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"  # word borders by ASCII letters only
    for pattern in (
        r"\[\d{2}:\d{2}\]",
        rf"(?i){start}Teacher{end}{SPACE}*\([A-Z]{{2}}\){SPACE}*:",
        rf"(?i){start}Student{end}{SPACE}*\([A-Z]{{2}}\){SPACE}*:",
        rf"(?i){start}(EN|UR|AR|ES){end}",
    ):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, SPACE + "{2,}", " ")
    return F.regexp_replace(out, EDGES, "")


def tokenize(text: Column) -> Column:
    """F8: lower-case words of ASCII word characters and the Arabic block."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^\\w{SPACE_CHARS}{ARABIC_BLOCK}]", "")
    return F.filter(F.split(kept, f"{SPACE}+"), lambda w: w != "")


def parse_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """F8: transcript lines as rows with time, speaker, speaker type and text."""
    pattern = rf"(?i)^\[(\d{{2}}:\d{{2}})\]{SPACE}*(Teacher|Student{SPACE}*\d*){SPACE}*\((\w+)\):{SPACE}*(.*)$"
    lines = posexplode_into(
        df, [c for c in df.columns if c != text], F.split(text, "\n"), "line_no", "_line"
    ).filter(F.trim(F.regexp_replace("_line", SPACE, " ")) != "")
    spoken = F.col("_line").rlike(pattern)
    speaker = F.trim(F.regexp_extract("_line", pattern, 2))
    whole = F.regexp_replace("_line", EDGES, "")
    return lines.withColumns(
        {
            "spoken_at": F.when(spoken, F.regexp_extract("_line", pattern, 1)).otherwise("--:--"),
            "speaker": F.when(spoken, speaker).otherwise("Unknown"),
            "speaker_type": F.when(spoken & F.contains(F.lower(speaker), F.lit("teacher")), "teacher").otherwise("student"),
            "line_text": F.when(spoken, F.trim(F.regexp_extract("_line", pattern, 4))).otherwise(whole),
        }
    ).drop("_line")


def script_of(text: Column) -> Column:
    """arabic when any letter of that script occurs, else latin."""
    return F.when(F.coalesce(text, F.lit("")).rlike(ARABIC_SCRIPT), "arabic").otherwise("latin")


def detect_language(text: Column) -> Column:
    """language by letter shares."""
    body = F.coalesce(text, F.lit(""))
    total = F.length(F.regexp_replace(body, SPACE, ""))

    def share(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern)) / total

    def any_word(words: list[str]) -> Column:
        return body.rlike("|".join(words))

    out = F.when(total == 0, "en")
    for code, block in INDIC_BLOCKS:
        out = out.when(share(block) > 0.2, code)
    return (
        out.when(share(SPANISH_LETTERS) > 0.01, "es")
        .when(
            share(f"[{ARABIC_BLOCK}]") > 0.5,
            F.when(any_word(ARABIC_WORDS) & ~any_word(URDU_WORDS), "ar").otherwise("ur"),
        )
        .otherwise("en")
    )


def feature_scores(text: Column, phrases: dict = FEATURE_PHRASES) -> Column:
    """struct of one score per feature: 0.5 per high and 0.3 per medium phrase."""
    lower = F.lower(text)

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lower, w)))

    return F.struct(
        *[
            (hits(lists["high"]) * 0.5 + hits(lists["medium"]) * 0.3).alias(feature)
            for feature, lists in phrases.items()
        ]
    )


def best_feature(scores: Column, names: list[str], threshold: float = 0.5) -> Column:
    """the best feature at or above the threshold; the first named wins a tie."""
    best = F.greatest(*[scores[n] for n in names])
    pick = F.coalesce(*[F.when(scores[n] == best, F.lit(n)) for n in names])
    return F.when(best >= threshold, pick)


def json_pick(json: Column, *paths: str) -> Column:
    """first path that is present and not null, as a number. Blank text counts as 0, other
    text becomes NULL."""
    found = F.coalesce(*[F.get_json_object(json, p) for p in paths])
    return F.when(F.trim(found) == "", F.lit(0.0)).otherwise(found.try_cast("double"))


SCORE_PATHS = ("$.scores.overall_percentage", "$.scores.percentage", "$.overall_percentage")


def count_correct(answers: Column) -> Column:
    """answers marked correct in an array of ``struct<correct boolean>``."""
    return F.when(answers.isNull(), 0).otherwise(F.size(F.filter(answers, lambda a: a["correct"])))


def mispronounced(json: Column, language: Column) -> Column:
    """words with an issue from either stored layout, as ``array<struct<word, issue>>``."""
    words = F.from_json(F.get_json_object(json, "$.words"), "array<struct<word:string,errorType:string>>")
    listed = F.from_json(
        F.get_json_object(json, "$.mispronounced_words"), "array<struct<word:string,description:string>>"
    )
    default = F.lit("Mispronunciation detected")
    marked = F.transform(
        F.filter(words, lambda w: w["errorType"] == "Mispronunciation"),
        lambda w: F.struct(w["word"].alias("word"), default.alias("issue")),
    )
    named = F.transform(
        listed,
        lambda w: F.struct(
            w["word"].alias("word"), F.coalesce(F.nullif(w["description"], F.lit("")), default).alias("issue")
        ),
    )
    none = F.array().cast("array<struct<word:string,issue:string>>")
    return F.when((language == "en") & words.isNotNull(), marked).when(listed.isNotNull(), named).otherwise(none)


def paragraph_chunks(text: Column, limit: int = 15000) -> Column:
    """paragraphs packed in order into chunks of at most ``limit`` characters; a longer
    paragraph stays whole. Works inside one row."""
    edge = EDGES
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, para: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(para) > limit) & (F.length(acc["cur"]) > 0)
        joined = F.when(acc["cur"] == "", para).otherwise(F.concat(acc["cur"], F.lit("\n\n"), para))
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.regexp_replace(acc["cur"], edge, "")))
            .otherwise(acc["done"])
            .alias("done"),
            F.when(full, para).otherwise(joined).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            acc["cur"] != "", F.array_append(acc["done"], F.regexp_replace(acc["cur"], edge, ""))
        ).otherwise(acc["done"])

    packed = F.aggregate(F.split(text, "\n\n"), start, step, finish)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)
