"""R: reading fluency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions.bands import comprehension
from chalkline.functions.letters import letters_correct
from chalkline.functions.maths import half_up
from chalkline.functions.spaces import EDGES, SPACE, SPACE_CHARS
from chalkline.functions.text import clean_transcript, tokenize

_ERROR = "struct<type:string,expected:string,actual:string,position:int>"
ALIGNED = f"correct int, omissions int, insertions int, substitutions int, distance int, errors array<{_ERROR}>"


def _next_row(prev: np.ndarray, word: int, heard: np.ndarray, first: int) -> np.ndarray:
    """Edit-distance row below ``prev``."""
    best = np.minimum(prev[:-1] + (heard != word), prev[1:] + 1)
    row = np.empty_like(prev)
    row[0] = first
    row[1:] = best
    steps = np.arange(len(row), dtype=prev.dtype)
    return np.minimum.accumulate(row - steps) + steps


def align(expected: list[str], actual: list[str]) -> tuple[int, int, int, int, int, list[tuple]]:
    """Word edit distance with its trace. Equal words match; otherwise a substitution is preferred to
    an omission and an omission to an insertion. Every few rows of the table are kept and the ones
    between are computed again on the way back, so a long text needs little memory."""
    codes: dict[str, int] = {}
    want = np.array([codes.setdefault(w, len(codes)) for w in expected], dtype=np.int64)
    heard = np.array([codes.setdefault(w, len(codes)) for w in actual], dtype=np.int64)
    n, m = len(want), len(heard)
    stride = max(int(np.sqrt(n)), 1)
    row = np.arange(m + 1, dtype=np.int64)
    kept = {0: row}
    for i in range(1, n + 1):
        row = _next_row(row, want[i - 1], heard, i)
        if i % stride == 0:
            kept[i] = row
    distance = int(row[m])
    errors: list[tuple] = []
    correct = omitted = inserted = swapped = 0
    i, j = n, m
    block: dict[int, np.ndarray] = {}
    while i > 0 or j > 0:
        if i > 0 and i - 1 not in block:
            base = (i - 1) // stride * stride
            block = {base: kept[base]}
            for k in range(base + 1, min(base + stride, n) + 1):
                block[k] = _next_row(block[k - 1], want[k - 1], heard, k)
        if i > 0 and j > 0 and want[i - 1] == heard[j - 1]:
            correct += 1
            i, j = i - 1, j - 1
            continue
        if i == 0:
            op = "insertion"
        elif j == 0:
            op = "omission"
        else:
            above = block[i - 1]
            cost = min(above[j - 1], above[j], block[i][j - 1]) + 1
            op = "substitution" if cost == above[j - 1] + 1 else "omission" if cost == above[j] + 1 else "insertion"
        if op == "substitution":
            swapped += 1
            errors.append((op, expected[i - 1], actual[j - 1], i - 1))
            i, j = i - 1, j - 1
        elif op == "omission":
            omitted += 1
            errors.append((op, expected[i - 1], None, i - 1))
            i -= 1
        else:
            inserted += 1
            errors.append((op, None, actual[j - 1], j - 1))
            j -= 1
    order = {"omission": 0, "insertion": 1, "substitution": 2}
    errors.reverse()
    errors.sort(key=lambda e: (e[3], order[e[0]]))
    return correct, omitted, inserted, swapped, distance, errors


def _align_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = ["correct", "omissions", "insertions", "substitutions", "distance", "errors"]
    for expected, actual in batches:
        rows = []
        for e, a in zip(expected, actual):
            out = align(list(e), list(a))
            errors = [dict(zip(("type", "expected", "actual", "position"), err)) for err in out[5]]
            rows.append((*out[:5], errors))
        yield pd.DataFrame(rows, columns=names)


def align_words(pairs: DataFrame, expected: str = "passage", actual: str = "words") -> DataFrame:
    """Adds ``alignment`` (counts, distance and errors by position) to pairs of word arrays.

    The work grows with the product of the two lengths and dwarfs the cost of moving the words, so
    the pairs are spread over all tasks first."""
    udf = F.pandas_udf(_align_batches, T.StructType.fromDDL(ALIGNED))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks).withColumn("alignment", udf(F.col(expected), F.col(actual)))


def elapsed_seconds(stamps: Column, audio: Column) -> Column:
    """Seconds from the first word's start to the last word's end, at least one; without stamps the
    audio length, else 60."""
    last = F.element_at(stamps, -1)
    end = F.coalesce(F.nullif(last["endMs"], F.lit(0)), last["startMs"], F.lit(0))
    span = (end - F.coalesce(F.get(stamps, F.lit(0))["startMs"], F.lit(0))) / 1000
    return F.when(F.coalesce(F.size(stamps), F.lit(0)) > 0, F.greatest(span, F.lit(1.0))).otherwise(
        F.when(audio > 0, audio).otherwise(60.0)
    )


def fluency_metrics(assessments: DataFrame) -> DataFrame:
    """R2: rate, accuracy and errors per assessment.

    ``assessments(id, passage_type, passage_text, transcript_text, word_timestamps,
    audio_duration_seconds)``. Letters are matched by spoken name, other passages by alignment.
    """
    words = assessments.withColumns(
        {
            "passage": tokenize(F.col("passage_text")),
            "words": tokenize(clean_transcript(F.col("transcript_text"))),
            "_spoken": clean_transcript(F.col("transcript_text")),
        }
    )
    letters = F.coalesce(F.col("passage_type") == "letters", F.lit(False))
    aligned = align_words(words.filter(~letters)).select(
        *words.columns,
        F.col("alignment.correct").alias("words_correct"),
        *[F.col(f"alignment.{c}").alias(f"{c}_count") for c in ("omissions", "insertions", "substitutions")],
        F.col("alignment.errors").alias("errors"),
    )
    spelled = words.filter(letters)
    matched = letters_correct(
        spelled.select("id", F.col("passage").alias("letters"), F.col("_spoken").alias("transcript"))
    ).select("id", "matched", "total")
    named = spelled.join(matched, "id").select(
        *words.columns,
        F.col("matched").alias("words_correct"),
        (F.col("total") - F.col("matched")).alias("omissions_count"),
        F.lit(0).alias("insertions_count"),
        F.lit(0).alias("substitutions_count"),
        F.lit(None).cast(f"array<{_ERROR}>").alias("errors"),
    )
    rows = aligned.unionByName(named)
    seconds = elapsed_seconds(F.col("word_timestamps"), F.col("audio_duration_seconds"))
    rate = F.col("words_correct") / (F.col("_seconds") / 60)
    total = F.size("passage")
    return rows.withColumn("_seconds", seconds).select(
        "id",
        total.alias("total_words"),
        F.size("words").alias("words_read"),
        "words_correct",
        (half_up(rate * 10) / 10).alias("wcpm"),
        F.when(total > 0, half_up(F.col("words_correct") / total * 1000) / 10).otherwise(0.0).alias("word_accuracy"),
        half_up(F.col("_seconds")).cast("bigint").alias("time_elapsed"),
        F.when(F.col("passage_type") == "letters", "LCPM").otherwise("WCPM").alias("metric_type"),
        "omissions_count",
        "insertions_count",
        "substitutions_count",
        "errors",
    )


def text_pronunciation(pairs: DataFrame, reference: str = "reference", heard: str = "heard") -> DataFrame:
    """Share of reference words present, fluency by length ratio, completeness and their mean.
    The heard words become a map, so each reference word costs one lookup."""

    def words(column: str) -> Column:
        kept = F.regexp_replace(F.lower(column), rf"[^\w{SPACE_CHARS}]", "")
        return F.split(F.regexp_replace(kept, EDGES, ""), f"{SPACE}+")

    split = pairs.withColumns({"_ref": words(reference), "_heard": words(heard)}).withColumn(
        "_known", F.map_from_entries(F.transform(F.array_distinct("_heard"), lambda w: F.struct(w, F.lit(True))))
    )
    hits = F.size(F.filter("_ref", lambda w: F.map_contains_key("_known", w)))
    ratio = F.size("_heard") / F.size("_ref")
    scored = split.withColumns(
        {
            "accuracy_score": half_up(hits / F.size("_ref") * 100).cast("int"),
            "fluency_score": half_up(F.greatest(F.lit(0.0), 100 - F.abs(ratio - 1) * 100)).cast("int"),
            "completeness_score": half_up(ratio * 100).cast("int"),
        }
    )
    return scored.withColumn(
        "pronunciation_score", half_up((F.col("accuracy_score") + F.col("fluency_score")) / 2).cast("int")
    ).drop("_ref", "_heard", "_known")


def comprehension_scores(answers: DataFrame) -> DataFrame:
    """``answers(assessment_id, grade_level, correct)`` to correct, total, score and status."""
    counts = answers.groupBy("assessment_id", "grade_level").agg(
        F.count_if("correct").alias("correct_answers"), F.count("*").alias("total_questions")
    )
    return counts.withColumns(
        {
            "score": half_up(F.col("correct_answers") / F.col("total_questions") * 100).cast("int"),
            "status": comprehension(F.col("correct_answers"), F.col("grade_level")),
        }
    )
