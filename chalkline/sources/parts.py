"""Tables whose parts are replaced together: data folders of each commit, and a pointer to those that count.

A table folder holds ``data/<id>/_part=<key>/`` with the rows of one commit and ``pointer/n=<number>/``
with one small text file a commit: which folder holds each part, the schema and a tag. A commit is that
one file, so a job that dies before it leaves the table as it was, and a reader opens only the folders
that the newest pointer names. One writer at a time; the parts of a table (days, months, batches) are
meant to be few enough to be listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NONE = "-"


def part_key(part: Column) -> Column:
    """Name of the part that a value belongs to: the hex digits of its text, ``-`` for null."""
    return F.coalesce(F.hex(part.cast("string")), F.lit(_NONE))


def key_of(text: str | None) -> str:
    """``part_key`` of one value's text."""
    return _NONE if text is None else text.encode().hex().upper()


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _path(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the commits, oldest first; a folder without its file was not committed."""
    found = []
    for name in _names(spark, f"{folder}/pointer"):
        if name.startswith("n=") and any(f.endswith(".txt") for f in _names(spark, f"{folder}/pointer/{name}")):
            found.append(int(name[2:]))
    return sorted(found)


def _read_pointer(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{folder}/pointer/n={number}").first()[0])


def pointer(spark: SparkSession, folder: str) -> dict | None:
    """The newest commit: ``parts`` (key to data folder), ``schema``, ``tag`` and ``number``; None before the first."""
    numbers = _committed(spark, folder)
    return _read_pointer(spark, folder, numbers[-1]) if numbers else None


def read_parts(spark: SparkSession, folder: str, only: Iterable[str] | None = None) -> DataFrame:
    """Rows of the newest commit, of the parts with the keys ``only`` if these are given."""
    now = pointer(spark, folder)
    if now is None:
        raise FileNotFoundError(f"no commit in {folder}")
    wanted = set(now["parts"]) if only is None else set(only) & set(now["parts"])
    schema = StructType.fromJson(now["schema"])
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{now['parts'][key]}" for key in sorted(wanted)])


def replace_parts(
    rows: DataFrame, folder: str, part: Column, gone: Iterable[str] | None = (), tag: object = None, keep: int = 2
) -> dict:
    """Commit ``rows``: each part that they hold replaces the part of that key, others stay.

    Parts whose keys are in ``gone`` go where ``rows`` bring none; ``gone=None`` lets all go, so the
    table becomes ``rows``. Rows are rebalanced by part, so a part gets few files and a large part many tasks.
    Data that none of the ``keep`` newest commits names is deleted after the commit.
    """
    return _commit(rows.withColumn("_part", part_key(part)), folder, gone, tag, keep)


def _commit(keyed: DataFrame, folder: str, gone: Iterable[str] | None, tag: object, keep: int) -> dict:
    """As ``replace_parts``, for rows that carry their key as ``_part``."""
    spark = keyed.sparkSession
    before = pointer(spark, folder) or {"parts": {}, "number": 0}
    written = f"data/{uuid.uuid4().hex}"
    keyed.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(f"{folder}/{written}")
    new = {n[len("_part=") :] for n in _names(spark, f"{folder}/{written}") if n.startswith("_part=")}
    kept = {} if gone is None else {k: v for k, v in before["parts"].items() if k not in set(gone)}
    number = before["number"] + 1
    now = {
        "number": number,
        "tag": tag,
        "schema": keyed.drop("_part").schema.jsonValue(),
        "parts": kept | {key: f"{written}/_part={key}" for key in sorted(new)},
    }
    line = spark.range(1, numPartitions=1).select(F.lit(json.dumps(now)).alias("value"))
    # a folder left by a writer that died before its file was there is no commit and may be replaced
    line.write.mode("overwrite").text(f"{folder}/pointer/n={number}")
    vacuum(spark, folder, keep)
    return now


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete pointers before the ``keep`` newest, and data that these do not name."""
    if keep < 1:
        raise ValueError("the newest commit stays")
    numbers = _committed(spark, folder)
    if not numbers:
        return
    named = {path for n in numbers[-keep:] for path in _read_pointer(spark, folder, n)["parts"].values()}
    old = [f"{folder}/pointer/n={n}" for n in numbers[:-keep]]
    for commit in _names(spark, f"{folder}/data"):
        inside = [p for p in _names(spark, f"{folder}/data/{commit}") if p.startswith("_part=")]
        unnamed = [p for p in inside if f"data/{commit}/{p}" not in named]
        if len(unnamed) == len(inside):
            old.append(f"{folder}/data/{commit}")
        else:
            old.extend(f"{folder}/data/{commit}/{p}" for p in unnamed)
    for path in old:
        files, target = _path(spark, path)
        files.delete(target, True)


def delete_rows(spark: SparkSession, folder: str, condition: Column, tag: object = None) -> int:
    """Delete the rows for which ``condition`` is true and return their number.

    One scan counts them by part; only parts that hold some are read again and written without them. The
    part of a row is the folder that it was read from, whatever the session's settings are now. The deleted
    rows are gone from the files when this returns; null is not true.
    """
    hit = F.coalesce(condition, F.lit(False))
    own = F.regexp_extract(F.col("_metadata.file_path"), "/_part=([^/]*)/", 1)
    now = pointer(spark, folder)
    if now is None or not now["parts"]:
        return 0
    counts = read_parts(spark, folder).filter(hit).groupBy(own.alias("key")).count().collect()  # a row a part
    if not counts:
        return 0
    touched = [r["key"] for r in counts]
    _commit(read_parts(spark, folder, touched).filter(~hit).withColumn("_part", own), folder, touched, tag, keep=1)
    return sum(r["count"] for r in counts)
