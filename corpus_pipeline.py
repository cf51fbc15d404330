"""A corpus from raw documents to packed sequences: the rows that a stage keeps are the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chalkline.llm.blocks import shared_folder
from chalkline.llm.exact import keep_exact
from chalkline.llm.mixing import take_mix
from chalkline.llm.packing import pack_documents
from chalkline.llm.quality import keep_quality, trusted_ids
from chalkline.llm.similar import keep_dissimilar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that a model of the trusted ones finds likely enough for their language."""
    return keep_quality(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id."""
    return keep_exact(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group connected by a likeness of 0.8 in shingles of five words, the one with the smallest id."""
    return keep_dissimilar(docs, words=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows none, once or twice, so that the words of each source come to its target."""
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("similar", similar), ("mix", mix), ("pack", pack)]

#: the model, the rounding of the mix and the packing are no SQL; tests hold each stage against plain loops
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet in the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
