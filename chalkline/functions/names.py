"""names, roll-call words, roster lines and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.rows import once, posexplode_into
from chalkline.functions.spaces import EDGES, SPACE, SPACE_CHARS

# Roll-call words.
PRESENT_WORDS = [
    "present", "yes", "here", "haan", "ji", "haazir", "hazir",
    "موجود", "حاضر", "ہاں", "جی",
]
ABSENT_WORDS = [
    "absent", "no", "not here", "nahi", "ghair hazir", "gairhazir",
    "غیر حاضر", "نہیں", "غائب",
]

# Country codes that cannot be delivered to.
BLOCKED_CODES = ["+53", "+98", "+850", "+963", "+7978"]


def bigrams(text: Column) -> Column:
    """Distinct character pairs."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))
    )
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def dice(a: Column, b: Column) -> Column:
    """1 for equal names, 0.7 + 0.3 x length ratio when one holds the other, else the bigram Dice score."""
    left, right = F.trim(F.lower(a)), F.trim(F.lower(b))
    blank = F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe("")
    return F.when(blank, F.lit(0.0)).otherwise(dice_of(left, right, bigrams(left), bigrams(right)))


def dice_of(left: Column, right: Column, grams_a: Column, grams_b: Column) -> Column:
    """F6 for lower-cased, trimmed texts whose letter pairs are at hand."""
    shared = F.size(F.array_intersect(grams_a, grams_b))
    sizes = F.size(grams_a) + F.size(grams_b)
    return (
        F.when(left == right, F.lit(1.0))
        .when(F.contains(right, left), F.lit(0.7) + F.length(left) / F.length(right) * 0.3)
        .when(F.contains(left, right), F.lit(0.7) + F.length(right) / F.length(left) * 0.3)
        .when((F.size(grams_a) == 0) | (F.size(grams_b) == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * shared / sizes)
    )


def normalize_status(text: Column) -> Column:
    """present, absent or unknown. Absent words win, since some hold a present word."""
    lower = F.regexp_replace(F.trim(F.lower(text)), f"{SPACE}+", " ")
    joined = F.regexp_replace(lower, SPACE, "")

    def says(words: list[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lower, F.lit(word)) | F.contains(joined, F.lit(word.replace(" ", "")))
        return hit

    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(says(ABSENT_WORDS), "absent")
        .when(says(PRESENT_WORDS), "present")
        .otherwise("unknown")
    )


def parse_roster(rosters: DataFrame, text: str = "text") -> DataFrame:
    """one row per student line with ``line_no``, ``student_name``, ``father_name``, ``parent_phone``."""
    split = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n"), "\n")
    lines = posexplode_into(rosters, [c for c in rosters.columns if c != text], split, "line_no", "_line")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("_line", EDGES, ""), rf"^\d+\.{SPACE}*", ""), f"^[-*•]{SPACE}*", "")
    cleaned = lines.withColumn("_line", bare).withColumn(
        "_found", F.nullif(F.regexp_extract("_line", rf"(\+?\d[\d{SPACE_CHARS}-]{{8,}}\d)", 1), F.lit(""))
    )
    without = F.regexp_replace("_line", rf"(?s)^(.*?)\+?\d[\d{SPACE_CHARS}-]{{8,}}\d", "$1 ")
    tidy = F.trim(F.regexp_replace(F.trim(F.regexp_replace(without, f"{SPACE}+", " ")), f"[,;|]{SPACE}*$", ""))
    cleaned = cleaned.withColumn("_line", F.when(F.col("_found").isNull(), F.col("_line")).otherwise(tidy))
    pair = f"(?i)^(.+?){SPACE}+[sd]/o{SPACE}+(.+)$"
    is_pair = F.col("_line").rlike(pair)
    comma = F.contains("_line", F.lit(","))
    name = (
        F.when(is_pair, F.trim(F.regexp_extract("_line", pair, 1)))
        .when(comma, F.trim(F.substring_index("_line", ",", 1)))
        .otherwise(F.col("_line"))
    )
    after = F.regexp_extract("_line", r"(?s)^[^,]*,(.*)$", 1)
    father = F.when(is_pair, F.trim(F.regexp_extract("_line", pair, 2))).when(
        comma, F.nullif(F.trim(after), F.lit(""))
    )
    return (
        cleaned.filter(F.col("_line") != "")
        .withColumns(
            {
                "student_name": name,
                "father_name": father,
                "parent_phone": F.regexp_replace("_found", f"[{SPACE_CHARS}-]", ""),
            }
        )
        .filter(F.col("student_name") != "")
        .drop("_line", "_found")
    )


def normalize_phone(raw: Column, country_code: str = "") -> Column:
    """``struct<valid, normalized, reason>`` with the reason required, letters, too_short,
    too_long, invalid or blocked."""
    digits_cc = "".join(ch for ch in country_code if ch.isdigit())

    def judge(text: Column, phone: Column) -> Column:
        digits = F.length(F.regexp_replace(phone, r"\D", ""))
        blocked = F.lit(False)
        for code in BLOCKED_CODES:
            blocked = blocked | phone.startswith(code)
        reason = (
            F.when(F.coalesce(text, F.lit("")) == "", "required")
            .when(phone.rlike("[a-zA-Z]"), "letters")
            .when(~phone.rlike(r"^\+[1-9]\d{6,14}$"), once(digits, lambda n: F.when(n < 7, "too_short").when(n > 15, "too_long").otherwise("invalid")))
            .when(blocked, "blocked")
        )
        return once(reason, lambda r: F.struct(r.isNull().alias("valid"), F.when(r.isNull(), phone).alias("normalized"), r.alias("reason")))

    def prefixed(phone: Column) -> Column:
        # a phone that gets the country code starts with +, so only one of the two prefixes is put in front
        out = F.when(phone.rlike(r"^\d{7,15}$"), F.concat(F.lit("+"), phone)).otherwise(phone)
        if digits_cc:
            out = F.when(phone.rlike(r"^0\d{6,}$"), F.concat(F.lit(f"+{digits_cc}"), F.substr(phone, F.lit(2)))).otherwise(out)
        return out

    return once(
        raw.cast("string"),
        lambda text: once(F.regexp_replace(text, rf"[{SPACE_CHARS}\-()]", ""), lambda bare: once(prefixed(bare), lambda phone: judge(text, phone))),
    )
