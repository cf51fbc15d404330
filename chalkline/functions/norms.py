"""Reference tables for J7, J8 and J9. All are small and fixed, so they enter plans as literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERCENTILES = [10, 25, 50, 75, 90]

# Words per minute needed to reach percentiles 10, 25, 50, 75, 90.
WORD_NORMS = {
    (1, "en", "fall"): (0, 2, 5, 10, 15),
    (1, "en", "winter"): (6, 12, 23, 34, 47),
    (1, "en", "spring"): (24, 34, 47, 59, 72),
    (1, "ur", "fall"): (0, 1, 4, 7, 11),
    (1, "ur", "winter"): (4, 8, 16, 24, 33),
    (1, "ur", "spring"): (17, 24, 33, 41, 50),
    (2, "en", "fall"): (18, 34, 51, 72, 87),
    (2, "en", "winter"): (31, 51, 72, 89, 107),
    (2, "en", "spring"): (45, 68, 89, 107, 123),
    (2, "ur", "fall"): (13, 24, 36, 50, 61),
    (2, "ur", "winter"): (22, 36, 50, 62, 75),
    (2, "ur", "spring"): (32, 48, 62, 75, 86),
    (3, "en", "fall"): (30, 53, 71, 107, 123),
    (3, "en", "winter"): (46, 71, 92, 120, 137),
    (3, "en", "spring"): (61, 83, 107, 137, 153),
    (3, "ur", "fall"): (21, 37, 50, 75, 86),
    (3, "ur", "winter"): (32, 50, 64, 84, 96),
    (3, "ur", "spring"): (43, 58, 75, 96, 107),
}

# Range used when a grade has no norms; 70 % of it for second-language Urdu.
WORD_FALLBACK = {1: (12, 34), 2: (51, 89), 3: (71, 107)}
WORD_FALLBACK_OTHER = (50, 100)
URDU_FACTOR = 0.70

# Letters per minute at percentiles 5, 10, 25, 50, 75, 90 in fall.
LETTER_PERCENTILES = [5, 10, 25, 50, 75, 90]
LETTER_NORMS = {
    (0, "en"): (0, 0, 2, 5, 12, 20),
    (1, "en"): (0, 2, 8, 29, 47, 58),
    (1, "ur"): (0, 1, 5, 20, 33, 40),
    (2, "en"): (22, 30, 42, 55, 67, 78),
    (2, "ur"): (15, 21, 29, 38, 47, 55),
    (3, "en"): (38, 45, 55, 68, 79, 89),
    (3, "ur"): (27, 32, 38, 48, 55, 62),
}
LETTER_FALLBACK = (20, 60)

# Grading scales as (lowest percentage, grade, grade points, division).
SCALES = {
    "fbise": [
        (90, "A+", 4.0, None),
        (80, "A", 4.0, None),
        (70, "B", 3.0, None),
        (60, "C", 2.0, None),
        (50, "D", 1.0, None),
        (40, "E", 0.0, None),
        (0, "F", 0.0, None),
    ],
    "cambridge": [
        (90, "A*", None, None),
        (80, "A", None, None),
        (70, "B", None, None),
        (60, "C", None, None),
        (50, "D", None, None),
        (40, "E", None, None),
        (30, "F", None, None),
        (20, "G", None, None),
        (0, "U", None, None),
    ],
    "matric": [
        (80, "A-1", None, "First"),
        (70, "A", None, "First"),
        (60, "B", None, "First"),
        (50, "C", None, "Second"),
        (40, "D", None, "Second"),
        (33, "E", None, "Third"),
        (0, "Fail", None, "Fail"),
    ],
    "generic": [
        (90, "A+", None, None),
        (80, "A", None, None),
        (70, "B", None, None),
        (60, "C", None, None),
        (50, "D", None, None),
        (0, "F", None, None),
    ],
}

# Names a board goes by, letters only.
BOARD_ALIASES = {
    "fbise": "fbise",
    "federal": "fbise",
    "cambridge": "cambridge",
    "igcse": "cambridge",
    "cie": "cambridge",
    "matric": "matric",
    "punjab": "matric",
    "ssc": "matric",
    "punjabmatric": "matric",
}
FAILING = ["F", "Fail", "U"]


def lookup(table: dict, key: Column, dtype: str) -> Column:
    """Literal map from a dict; values may be None."""
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v).cast(dtype)]
    return F.create_map(*pairs)[key]


def board_scale(board: Column) -> Column:
    """Scale name of a board; unknown boards use the generic one."""
    letters = F.regexp_replace(F.lower(F.coalesce(board, F.lit(""))), "[^a-z]", "")
    return F.coalesce(lookup(BOARD_ALIASES, letters, "string"), F.lit("generic"))


def grade_of(pct: Column, scale: Column) -> Column:
    """First band whose lowest percentage is reached, as ``struct<grade, gpa, division>``;
    below every band the last one."""

    def band(name: str) -> Column:
        def cell(row):
            return F.struct(
                F.lit(row[1]).alias("grade"),
                F.lit(row[2]).cast("double").alias("gpa"),
                F.lit(row[3]).cast("string").alias("division"),
            )

        rows = SCALES[name]
        out = cell(rows[-1])
        for row in reversed(rows[:-1]):
            out = F.when(pct >= row[0], cell(row)).otherwise(out)
        return out

    out = band("generic")
    for name in ("fbise", "cambridge", "matric"):
        out = F.when(scale == name, band(name)).otherwise(out)
    return out
