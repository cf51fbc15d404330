"""Drain a stream into files and read them back, for tests, checks and catch-up runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach: below ``spark.checkpoint.dir``; a local one only when
    nothing is configured and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="chalkline-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there in append mode and return the written rows."""
    folder = work_folder(stream.sparkSession, name)
    started = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_updates(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Process what is there in update mode and return the newest row per key."""
    folder = work_folder(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    started = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch")
    whole = F.struct(*[F.col(c) for c in stream.columns])
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, "_batch").alias("r")).select("r.*")
