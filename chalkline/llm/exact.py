"""Exact duplicates by Grace hashing: spill files until each bucket fits an open-addressing table."""

from __future__ import annotations

import hashlib
import os
import pickle
import random
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks

_NONE = -(1 << 63)
_GROUP = "key long, text binary, keep long, size long"


class Table:
    """Open addressing with linear probing; a slot is taken by a text only after its whole content was compared."""

    def __init__(self):
        self.slots = np.full(1 << 10, -1, np.int64)
        self.key: list[int] = []
        self.text: list[bytes] = []
        self.keep: list[int] = []
        self.size: list[int] = []
        self.bytes = 0

    def _free(self, key: int) -> int:
        mask = len(self.slots) - 1
        at = key & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        return at

    def add(self, key: int, text: bytes, keep: int, size: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        at = key & mask
        while (i := slots[at]) >= 0:
            if self.key[i] == key and self.text[i] == text:
                self.size[i] += size
                if keep > self.keep[i]:
                    self.keep[i] = keep
                return
            at = (at + 1) & mask
        slots[at] = len(self.key)
        self.key.append(key)
        self.text.append(text)
        self.keep.append(keep)
        self.size.append(size)
        self.bytes += len(text) + 64
        if len(self.key) * 3 > len(slots) * 2:
            self.slots = np.full(len(slots) * 2, -1, np.int64)
            for i, k in enumerate(self.key):
                self.slots[self._free(k)] = i

    def rows(self) -> Iterator[tuple[int, bytes, int, int]]:
        return zip(self.key, self.text, self.keep, self.size)


def _scratch() -> str | None:
    """One of the folders that Spark itself spills to on this executor."""
    folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return random.choice(folders) if folders else None


def grace(rows: Iterator[tuple[int, bytes, int, int]], limit: int, fanout_bits: int = 4, level: int = 0):
    """Merge rows of equal text. At most about ``limit`` bytes of different texts are held at once.

    When the table is full, it and all later rows go to ``2 ** fanout_bits`` spill files by the
    next bits of the key, and each file is merged in the same way. Copies never overflow the
    table, as it holds a text once. Texts that share all 64 bits of the key cannot be parted by
    them and stay in one table, where the contents are compared. The files belong to one task
    attempt, as the files of a sort that spills do, and are gone when it ends.
    """
    table, shift = Table(), 64 - fanout_bits * (level + 1)
    for row in rows:
        table.add(*row)
        if table.bytes > limit and shift >= 0 and len(table.key) > 1:
            break
    else:
        yield from table.rows()
        return
    with tempfile.TemporaryDirectory(dir=_scratch(), prefix="grace-") as folder:
        names = [os.path.join(folder, str(i)) for i in range(1 << fanout_bits)]
        files = [open(name, "wb") for name in names]
        try:
            for part in (table.rows(), rows):
                for row in part:
                    pickle.dump(row, files[((row[0] & (2**64 - 1)) >> shift) & ((1 << fanout_bits) - 1)], 5)
        finally:
            for f in files:
                f.close()
        del table

        def read(name):
            with open(name, "rb") as f:
                while True:
                    try:
                        yield pickle.load(f)
                    except EOFError:
                        return

        for name in names:
            yield from grace(read(name), limit, fanout_bits, level + 1)
            os.unlink(name)


def _batches(rows, schema: pa.Schema, most: int = 8 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_ARROW = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("keep", pa.int64()), ("size", pa.int64())])
_OUT = pa.schema([("sha", pa.binary()), ("unused", pa.binary()), ("keep", pa.int64()), ("size", pa.int64())])


def _rows(batches):
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = 48 << 20) -> DataFrame:
    """One row per different text: text_sha256, keep_id (largest id), group_size.

    The map side merges the copies that meet in one task (a flush every 16 MB), so that a text
    held by a third of all rows reaches its bucket once per flush, not once per row. Rows then
    go to Spark partitions by a 64-bit hash, and ``grace`` takes them apart there.
    """

    def collapse(batches):
        def merged():
            table = Table()
            for row in _rows(batches):
                table.add(*row)
                if table.bytes > 16 << 20:
                    yield from table.rows()
                    table = Table()
            yield from table.rows()

        yield from _batches(merged(), _ARROW)

    def settle(batches):
        rows = ((hashlib.sha256(t).digest(), b"", keep, n) for _, t, keep, n in grace(_rows(batches), limit))
        yield from _batches(rows, _OUT)

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.xxhash64(whole).alias("key"),
        whole.cast("binary").alias("text"),
        F.coalesce(F.col(id).cast("long"), F.lit(_NONE)).alias("keep"),
        F.lit(1).cast("long").alias("size"),
    )
    groups = (
        rows.mapInArrow(collapse, _GROUP)
        .repartition("key")
        .mapInArrow(settle, "sha binary, unused binary, keep long, size long")
    )
    return groups.select(
        "sha",
        F.when(F.col("keep") != _NONE, F.col("keep")).alias("keep_id"),
        F.col("size").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = 48 << 20) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays; a
    null id is the smallest. Rows that repeat both id and text are one document and share the
    verdict. Texts meet by content in ``exact_groups``; rows then find their group by the digest.
    That join moves no text, and one row stands on the side of the groups, so Spark may split a
    key of many rows. An empty table gives an empty table; other columns are not looked at.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.unhex(digest).alias("sha"))
    joined = rows.join(exact_groups(docs, id, text, limit), "sha")
    return joined.select(
        F.col("_id").alias(id),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = 48 << 20) -> DataFrame:
    """One row of each group of equal texts, with all its columns: one that has the largest id.

    Rows that repeat id and text are one document, so one of them stays. ``docs`` is a stored table.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = docs.select(
        F.col(id).cast("long").alias("_id"), digest.alias("sha"), F.spark_partition_id().alias("block"), blocks.row_key(id, text).alias("row_key")
    )
    heads = rows.join(exact_groups(docs, id, text, limit), "sha").where(F.col("_id").eqNullSafe(F.col("keep_id")))
    chosen = heads.groupBy("sha").agg(F.min(F.struct("block", "row_key")).alias("one"))
    return blocks.repeat_rows(docs, chosen.select("one.block", "one.row_key", F.lit(1).alias("copies")), id, text)
