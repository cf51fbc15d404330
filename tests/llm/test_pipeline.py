"""Each stage against plain loops over its own input."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from plain import targets_by_rounds
from test_mixing import size
from test_packing import brute_pieces
from test_similar import brute

from chalkline.llm import blocks
from chalkline.llm.quality import judge_quality, trusted_ids

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    folder = blocks.shared_folder(spark, "stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"input": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_stay(tables):
    for name, _ in pipeline.STAGES[:-1]:
        assert tables[name].schema == tables["input"].schema


def test_quality_stage(spark, tables):
    verdict = judge_quality(tables["input"], trusted_ids(spark.read.parquet(f"{FOLDER}/labels.parquet")))
    keep = {r.doc_id for r in verdict.where("kept").collect()}
    want = [r for r in rows(tables["input"]) if r[0] in keep]
    assert sorted(rows(tables["quality"])) == sorted(want) and 0 < len(want) < tables["input"].count()


def test_exact_stage(tables):
    best = {}
    for r in rows(tables["quality"]):
        best[r[1]] = max(best.get(r[1], r), r)
    assert sorted(rows(tables["exact"])) == sorted(best.values())


def test_similar_stage(tables):
    given = rows(tables["exact"])
    want = {i for i, n, c in brute([r[:2] for r in given], 5, 80, 100) if i == c or n == 0}
    assert sorted(rows(tables["similar"])) == sorted(r for r in given if r[0] in want)


def test_mix_stage(tables):
    given, taken = rows(tables["similar"]), rows(tables["mix"])
    copies = Counter(taken)
    assert set(copies) <= set(given) and max(copies.values()) <= 2
    total, got = Counter(), Counter()
    for r in given:
        total[r[3]] += size(r[1])
    for r in taken:
        got[r[3]] += size(r[1])
    for s, target in targets_by_rounds(dict(total)).items():
        assert abs(got[s] - target) <= max(40, 0.02 * target), (s, got[s], target)


def test_pack_stage(tables):
    got = rows(tables["pack"])
    assert sorted(r[:5] for r in got) == sorted(brute_pieces([r[:2] for r in rows(tables["mix"])], 2048))


def test_stages_on_odd_rows(spark, docs):
    rng = random.Random(1)
    text = lambda k: " ".join(rng.choices(["a", "b", "the", "ü", "x9"], k=k))
    odd = [(i, text(rng.choice([0, 1, 30])), rng.choice(["en", None]), rng.choice(["s", None])) for i in range(30)]
    odd += [(None, "t", None, None), (None, None, None, None), (3, odd[4][1]), (3, odd[4][1]), (7, "y " * 90_000, "en", "s")]
    df = docs(odd)
    for name, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, df, FOLDER)
        assert out.schema == df.schema
        assert out.count() > 0, name
        empty = docs([])
        assert stage(spark, empty, FOLDER).count() == 0, name
    exact = [r[:2] for r in rows(pipeline.exact(spark, df, FOLDER))]
    assert len({t or "" for _, t in exact}) == len(exact) == len({r[1] or "" for r in odd})


def test_run(spark):
    got = pipeline.run(spark, FOLDER)
    assert got.count() > 0 and "sequence_id" in got.columns
