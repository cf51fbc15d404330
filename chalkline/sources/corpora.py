"""Lesson segments and completion ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.rows import posexplode_into

SEGMENT = (
    "segment_index bigint, day_label string, chapter_number bigint, chapter_title string, topic string, "
    "skill_type string, cpa_phase string, section string, pages_printed array<bigint>, pages_pdf array<bigint>, "
    "slo_codes array<string>, slo_descriptions array<string>, blooms string, duration_min bigint, "
    "new_or_revision string, prev_segment_id bigint, next_segment_id bigint, notes string"
)
LEDGER = "ts string, stage string, unit string, artifact string"


def book_columns(path: Column) -> dict[str, Column]:
    """Book id, grade and subject from a file name like ``grade_2_math_full_segments.json``."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    book = F.regexp_replace(F.url_decode(name), r"_(full_)?segments?$", "")
    shape = r"^grade_([A-Za-z0-9_]+?)_(.+)$"
    known = book.rlike(shape)
    return {
        "book_id": book,
        "grade": F.when(known, F.regexp_extract(book, shape, 1)).otherwise("?"),
        "subject": F.when(known, F.replace(F.regexp_extract(book, shape, 2), F.lit("_"), F.lit(" "))).otherwise(book),
    }


def parse_segments(files: DataFrame) -> DataFrame:
    """One row per lesson segment of ``files(path, value)``, a file's text in one row.

    A file holds a list or an object with a ``segments`` list; a file that is neither is skipped.
    The order inside a file stays known as ``position``."""
    items = f"array<struct<{_struct(SEGMENT)}>>"
    listed = F.from_json("value", items)
    wrapped = F.from_json("value", f"struct<segments:{items}>")["segments"]
    is_list = F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")
    rows = files.withColumn("_items", F.when(is_list, listed).otherwise(wrapped)).withColumns(
        book_columns(F.col("path"))
    )
    return posexplode_into(rows, ["book_id", "grade", "subject"], F.col("_items"), "position", "s").select(
        "book_id", "grade", "subject", "position", "s.*"
    )


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of every ``*_full_segments.json`` below ``folder``."""
    files = spark.read.text(f"{folder}/*_full_segments.json", wholetext=True)
    return parse_segments(files.select("value", F.col("_metadata.file_path").alias("path")))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(",")))


def parse_ledger(lines: DataFrame) -> DataFrame:
    """S3: ``lines(value)`` with a ``malformed`` flag: broken JSON or one of the four keys missing."""
    lines = lines.filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    complete = F.lit(True)
    for key in ("ts", "stage", "unit", "artifact"):
        complete = complete & F.coalesce(F.array_contains(keys, key), F.lit(False))
    return lines.select(F.from_json("value", LEDGER).alias("r"), (~complete).alias("malformed")).select(
        "r.*", "malformed"
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """S3: the lines of a ledger file. Spark's readers pass over names that start with an underscore or a
    dot, so the file must have a visible one."""
    if path.rstrip("/").rsplit("/", 1)[-1][:1] in ("_", "."):
        raise ValueError(f"give the ledger a name that Spark's readers see: {path}")
    return parse_ledger(spark.read.text(path))


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """S3: stamped and malformed lines."""
    return ledger.agg(
        F.count_if(~F.col("malformed")).alias("stamped"), F.count_if("malformed").alias("malformed")
    )
