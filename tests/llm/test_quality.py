import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.llm import quality
from chalkline.llm.queries import table as read


class Plain:
    """The model with dictionaries, straight from the definition."""

    def __init__(self, texts, order):
        self.order, raw = order, defaultdict(int)
        for t in texts:
            for g in self.grams(t):
                raw[g] += 1
        self.a = {order: dict(raw)}
        raws = {order: dict(raw)}
        for n in range(order - 1, 0, -1):
            left, sums = defaultdict(set), defaultdict(int)
            for g, c in raws[n + 1].items():
                left[g[1:]].add(g[0])
                sums[g[1:]] += c
            raws[n] = dict(sums)
            self.a[n] = {g: sums[g] if g[0] == 0 else len(left[g]) for g in sums}
        self.d, self.all, self.off = {}, {}, {}
        for n, t in self.a.items():
            counts = [sum(1 for c in t.values() if c == k) for k in range(1, 5)]
            self.d[n] = quality.discounts(*counts)
            self.all[n], self.off[n] = defaultdict(int), defaultdict(float)
            for g, c in t.items():
                self.all[n][g[:-1]] += c
                self.off[n][g[:-1]] += self.d[n][min(c, 3) - 1]

    def grams(self, t):
        s = bytes(self.order - 1) + t.encode().replace(b"\0", b"\1") + b"\0"
        return [s[i : i + self.order] for i in range(len(s) - self.order + 1)]

    def p(self, g):
        if not g:
            return 1 / 257
        n, ctx = len(g), g[:-1]
        below = self.p(g[1:])
        if not self.all[n].get(ctx):
            return below
        c = self.a[n].get(g, 0)
        own = c - self.d[n][min(c, 3) - 1] if c else 0
        return (own + self.off[n][ctx] * below) / self.all[n][ctx]

    def perplexity(self, t):
        gs = self.grams(t)
        return math.exp(-sum(math.log(self.p(g)) for g in gs) / len(gs)) if t else None


def rows_of(seed, n=140):
    rng = random.Random(seed)
    parts = {"en": ["the", "th", "er", " ", "ing", ". "], "de": ["der", "ß", "ü", "en", " ", "sch"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", None])
        rows.append((i, "".join(rng.choices(parts[lang or "en"], k=rng.randrange(1, 60))), lang))
    return rows


@pytest.mark.parametrize("order", [1, 3, 5])
def test_perplexity_equals_definition(docs, spark, order):
    rows = rows_of(1) + [(500, None, "en"), (501, "", "en"), (502, "@@@$$$" * 50, "en"), (503, "\0\1x", "xx"), (None, "the", "en"), (3, "second row of an id", "en")]
    trusted = spark.createDataFrame([(i,) for i in range(0, 120)] + [(None,), (7,)], "doc_id long")
    got = quality.judge_quality(docs(rows), trusted, order=order).collect()
    marks = spark.createDataFrame([(r[0],) for r in rows], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(4)).alias("f")).collect()
    held = {r.i for r in marks if r.f == 0}
    known = [r for r in rows if r[0] is not None and r[0] < 120]
    model = Plain([t for i, t, _ in known if i not in held], order)
    want = {(i, t): model.perplexity(t or "") for i, t, _ in rows}
    limits = [want[i, t] for i, t, _ in known if i in held and t]
    assert len(got) == len(rows) and len(limits) > 10
    values = sorted((str(r.doc_id), r.perplexity or 0) for r in got)
    for (i, x), (j, y) in zip(values, sorted((str(i), p or 0) for (i, _), p in want.items())):
        assert i == j and x == pytest.approx(y, rel=1e-5)
    by = {r.doc_id: r for r in got}
    assert not by[500].kept and not by[501].kept and by[500].perplexity is None
    assert by[502].perplexity > by[502].threshold and not by[502].kept
    pooled = sorted(limits)[math.ceil(0.99 * len(limits)) - 1] * 1.25
    assert by[503].threshold == pytest.approx(pooled * math.exp(2 / math.sqrt(4)), rel=1e-5)
    assert np.mean([r.kept for r in got if r.doc_id in range(140)]) > 0.97


def test_probabilities_sum_to_one():
    model = Plain(["the thing", "then", ""], 3)
    for ctx in (b"\0\0", b"th", b"zz", b"n\0"[:2]):
        assert sum(model.p(ctx + bytes([x])) for x in range(256)) + (1 / 257) * 0 <= 1 + 1e-9


def test_rows_pass_whole(docs, spark):
    rows = rows_of(2) + [(900, "#" * 300, "en"), (900, "the ther ing", "en"), (901, None, None)]
    df = docs(rows).withColumn("perplexity", F.lit("clash")).withColumn("threshold", F.lit(1)).withColumn("tags", F.array(F.lit("x")))
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    kept = quality.keep_quality(df, trusted)
    assert kept.columns == df.columns and kept.schema == df.schema
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert (900, "the ther ing") in ids and not any(t and t.startswith("#") or t is None for _, t in ids) and len(ids) > 130


def test_without_trust_or_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.judge_quality(docs([(1, "abc", "en"), (2, "", "en")]), none).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (2, False)]
    assert quality.judge_quality(docs([]), none).count() == 0


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    got = quality.judge_quality(docs, quality.trusted_ids(labels)).join(labels, "doc_id").toPandas()
    assert got[(got.quality == 1) & (got.toxic == 0)].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.4


def test_grams_by_hand():
    g, row = quality.grams(pa.array([b"ab", b"", b"c"], pa.binary()), 3)
    assert [int(x).to_bytes(3, "big") for x in g] == [b"\0\0a", b"\0ab", b"ab\0", b"\0\0\0", b"\0\0c", b"\0c\0"]
    assert row.tolist() == [0, 0, 0, 1, 2, 2]


def test_bad_labels_are_not_kept(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    got = quality.judge_quality(docs, quality.trusted_ids(labels)).join(labels, "doc_id").toPandas()
    bad = got[got.quality == 0]
    assert len(bad) > 50 and bad.kept.mean() < 0.02
    assert (bad.toxic == 1).sum() > 5 and not bad[bad.toxic == 1].kept.any()
    assert got[(got.quality == 1) & (got.toxic == 0)].kept.mean() > 0.98


def test_spam_and_bad_stretch_of_likely_words(docs, spark):
    rng = random.Random(5)
    prose = lambda k: " ".join(rng.choice(["der", "die", "und", "ein", "gar", "was", "nun", "ist", "zu", "am"]) for _ in range(k))
    rows = [(i, prose(rng.randrange(3, 300)), "de") for i in range(400)]
    rows += [(1000, "der " * 300, "de"), (1001, prose(400) + " der" * 100 + " " + prose(400), "de"), (1002, prose(800) + " #@%&~^|$" * 16 + " " + prose(800), "de")]
    trusted = spark.createDataFrame([(i,) for i in range(400)], "doc_id long")
    got = {r.doc_id: r for r in quality.judge_quality(docs(rows), trusted).collect()}
    assert np.mean([got[i].kept for i in range(400)]) > 0.97
    assert not got[1000].kept and got[1000].perplexity < got[1000].threshold
    assert not got[1001].kept and not got[1002].kept


def test_stretch_and_fresh_by_hand():
    rng = np.random.default_rng(3)
    size = [1, 5, 31, 32, 33, 127, 128, 129, 300, 1000]
    row = np.repeat(np.arange(len(size)), size)
    logp, g = -rng.random(len(row)), rng.integers(0, 9, len(row), dtype=np.uint64)
    worst, fresh = quality.worst_stretch(row, logp, len(size)), quality.least_fresh(row, g, len(size))
    for i, n in enumerate(size):
        p, x = logp[row == i], g[row == i]
        cells = -(-n // 32)
        starts = range(0, max(cells - 4, 0) * 32 + 1, 32)
        assert worst[i] == pytest.approx(max(-p[s : s + 128].mean() for s in starts))
        k = -(-n // 256)
        pieces = [x[np.arange(n) * k // n == j] for j in range(k)]
        assert fresh[i] == pytest.approx(min(len(set(q.tolist())) / len(q) for q in pieces))


def test_other_splits_between_passes_fail(docs, spark, monkeypatch):
    table = docs(rows_of(5), parts=6)
    trusted = spark.createDataFrame([(i,) for i in range(0, 140, 2)], "doc_id long")
    fit = quality.fit

    def fit_then_change(counts, order):
        out = fit(counts, order)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    monkeypatch.setattr(quality, "fit", fit_then_change)
    try:
        with pytest.raises(Exception, match="other rows than before"):
            quality.judge_quality(table, trusted).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_orders_that_do_not_fit_are_refused(docs, spark):
    with pytest.raises(ValueError, match="order"):
        quality.judge_quality(docs(rows_of(5)), spark.createDataFrame([(1,)], "doc_id long"), order=6)
