"""learning-outcome codes SUBJ-GG-STRAND-NN[a]. Drift is labelled, never corrected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = r"([A-Za-z]{1,4})-(\d{2})-([A-Za-z]{2,4})-(\d{2})([a-z]?)"

# Grade words in book names.
GRADE_WORD = {
    "1": "01",
    "2": "02",
    "3": "03",
    "4": "04",
    "5": "05",
    "one": "01",
    "two": "02",
    "three": "03",
    "four": "04",
    "five": "05",
}


def parse_code(raw: Column) -> Column:
    """Struct of code parts; ``malformed`` when no code starts the text."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    malformed = ~text.rlike(rf"^{CODE}")
    bare = F.regexp_extract(text, rf"^({CODE})", 1)
    rest = F.substr(text, F.length(bare) + 1)
    note = F.regexp_replace(F.regexp_replace(rest, r"^[ \[\]—\-\t\n]+", ""), r"[ \[\]—\-\t\n]+$", "")

    def part(i: int) -> Column:
        return F.regexp_extract(text, rf"^{CODE}", i)

    return F.struct(
        F.when(malformed, text).otherwise(bare).alias("code"),
        part(1).alias("subject"),
        part(2).alias("grade"),
        part(3).alias("strand"),
        part(4).alias("num"),
        part(5).alias("suffix"),
        F.when(malformed, "").otherwise(note).alias("fused_note"),
        malformed.alias("malformed"),
    )


def grade_code(grade: Column) -> Column:
    pairs = [F.lit(x) for pair in GRADE_WORD.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[grade.cast("string")], grade.cast("string"))


def validate_code(raw: Column, book_grade: Column | None = None) -> Column:
    """Issue labels of a raw code, empty when clean."""
    parsed = parse_code(raw)
    ok = ~parsed["malformed"]
    issues = [
        F.when(parsed["malformed"], "MALFORMED"),
        F.when(ok & (parsed["fused_note"] != ""), "FUSED_ANNOTATION"),
    ]
    if book_grade is not None:
        issues.append(F.when(ok & book_grade.isNotNull() & (parsed["grade"] != grade_code(book_grade)), "GRADE_MISMATCH"))
    return F.array_compact(F.array(*issues))
