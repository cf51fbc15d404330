import random
import zlib

import numpy as np
import pyarrow as pa

from chalkline.llm import langid
from chalkline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_language_id"](spark, FOLDER).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and truth[r.doc_id].lang]
    right = np.mean([r.lang_pred == truth[r.doc_id].lang for r in held])
    accepted = [r for r in held if not r.rejected]
    print(right, len(accepted) / len(held))
    assert right > 0.97
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in accepted]) > 0.98 and len(accepted) > 0.8 * len(held)


def test_odd_rows(docs, spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(["the", "and", "with"], k=30)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choices(["der", "und", "nicht"], k=30)), "de") for i in range(40)]
    model = langid.train(docs(rows))
    odd = [(1, None), (2, ""), (3, "123 %% \n"), (4, "the and " * 50_000), (5, "nicht"), (5, "nicht"), (None, "with the"), (6, "日本")]
    got = sorted(map(tuple, langid.identify(docs(odd), model).collect()), key=str)
    by = {}
    for i, lang, score, rejected in got:
        by.setdefault(i, []).append((lang, score, rejected))
    assert len(got) == len(odd)
    assert all(by[i] == [("und", 0.0, True)] for i in (1, 2, 3))
    assert by[4][0][0] == "en" and by[5][0][0] == "de" and by[5][0] == by[5][1] and by[None][0][0] == "en"
    assert by[6][0][0] in ("en", "de")
    assert langid.train(docs([])) is None and langid.train(docs([(1, "a b", None)])) is None
    assert langid.identify(docs(odd), None).where("lang_pred = 'und' AND rejected").count() == len(odd)
    assert langid.identify(docs([]), model).count() == 0


def test_subwords_by_hand():
    bucket, row = langid.subwords(pa.array([" ab1  c ", "", "é"]), 20)
    # " ab", "ab ", "b  ", " c " and " ab ", "ab  ", "b   ": none starts with two borders
    assert (row == 0).sum() == 4 + 3
    assert not (row == 1).any()
    same, _ = langid.subwords(pa.array([" AB?  C "]), 20)
    assert sorted(same) == sorted(bucket[row == 0])
