import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parent, Path(__file__).resolve().parents[2]):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Store a documents table of (doc_id, text[, lang, source]) rows, with columns whose names clash with results."""

    def make(rows, parts=3):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        df = df.selectExpr("*", "length(text) AS n_chars", "'x' AS kept", "1 AS size", "'k' AS key", "2 AS sha", "0 AS n")
        folder = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        df.repartition(parts).write.parquet(folder)
        return spark.read.parquet(folder)

    return make
