"""Side tables by block of a stored table: what a later scan must know about the rows of its own split.

A scan of stored files gives the same splits each time it is planned, so a fact about the rows of
split ``b`` can be kept in a small file of its own in the shared folder and be read by the task
that scans split ``b`` again. The text itself then never moves. Each file carries the number of
rows and a checksum of the ids of its split; a scan that finds other rows fails.
"""

from __future__ import annotations

import ctypes
import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    from chalkline.session import cut_lineage

    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(0))  # sets the folder of a local session, or says that none is set
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write a file at once: under a name of its own, then renamed; a second attempt writes the same bytes."""
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    held = io.BytesIO()
    np.savez(held, **arrays)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own, compression=None) as f:
        f.write(held.getvalue())
    try:
        files.move(own, f"{root}/{name}")
    except OSError:
        if files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
            raise
        files.delete_file(own)


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file; none if it was never written."""
    files, root = open_folder(folder)
    try:
        with files.open_input_stream(f"{root}/{name}", compression=None) as f:
            with np.load(io.BytesIO(f.read())) as z:
                return dict(z)
    except FileNotFoundError:
        return {}


def release() -> None:
    """Give memory that arrays have left back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a reduced table (counts, edges, models) in as many files as the cluster has cores, not one a partition.

    Not for a scan that asks for its split: the tasks are no longer those of the splits.
    """
    from chalkline.session import cut_lineage

    return cut_lineage(df.coalesce(df.sparkSession.sparkContext.defaultParallelism))


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_shard(rows: DataFrame, count: int) -> DataFrame:
    return rows.repartition(count, "shard")


def checksum(ids: np.ndarray, so_far: tuple[int, int] = (0, 0)) -> tuple[int, int]:
    """Rows and sum of mixed ids, whatever the order of the rows."""
    from chalkline.llm.words import mix

    total = int(mix(ids.astype(np.int64).view(np.uint64)).sum(dtype=np.uint64))
    return so_far[0] + len(ids), (so_far[1] + total) % 2**64


def row_key(id: str, text: str) -> Column:
    """64 bits of the id and the whole text: rows that share them are interchangeable."""
    return F.xxhash64(F.col(id), F.col(text))


def repeat_rows(docs: DataFrame, decisions: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs``, with all its columns, as often as its decision says.

    ``decisions``: (block, row_key, copies), one for each row that is to stay; rows without one go.
    ``block`` is spark_partition_id() of the same stored table. The decisions of a split go to its
    file and are applied while it is read again, so rows are not shuffled; of rows with equal keys
    each takes one of the decisions.
    """
    spark, columns = docs.sparkSession, docs.columns
    folder, count = shared_folder(spark, "rows"), shards(spark)

    def keep(batches):
        parts: dict[int, list] = {}
        for b in batches:
            block, key, copies = (b.column(c).to_numpy() for c in ("block", "key", "copies"))
            for x in np.unique(block).tolist():
                parts.setdefault(x, []).append((key[block == x], copies[block == x]))
        for block, found in parts.items():
            key, copies = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((-copies, key))
            save(folder, f"rows-{block}", key=key[order], copies=copies[order])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32())], names=["block"])

    kept = decisions.select(
        F.col("block").cast("int").alias("block"), F.col("row_key").cast("long").alias("key"), F.col("copies").cast("long").alias("copies")
    )
    kept.repartition(count, "block").mapInArrow(keep, "block int").agg(F.count("*")).collect()

    def apply(batches):
        from pyspark import TaskContext

        side = load(folder, f"rows-{TaskContext.get().partitionId()}")
        if not side:
            return
        keys, copies, used = side["key"], side["copies"], np.zeros(len(side["key"]), bool)
        for batch in batches:
            times = np.zeros(batch.num_rows, np.int64)
            mine = batch.column(len(columns)).to_numpy()
            first, last = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
            for i in np.flatnonzero(first < last).tolist():
                free = first[i] + np.flatnonzero(~used[first[i] : last[i]])[:1]
                if len(free):
                    used[free] = True
                    times[i] = copies[free[0]]
            out = pa.RecordBatch.from_arrays(batch.columns[: len(columns)], names=columns)
            yield out.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
        if not used.all():
            raise RuntimeError("a split holds other rows than before; store the table first")

    return docs.select(*columns, row_key(id, text).alias("__key")).mapInArrow(apply, docs.schema)
