import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from chalkline.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(text):
    out, above, open_, inside = [], "", [], ""
    paragraphs = text.split("\n")
    for k, p in enumerate(paragraphs):
        sentences = re.split(r"(?<=[.!?|;:] )", p)
        runs = [r for s in sentences for r in regex.findall(r"(?s).{15,39}?(?<=[dnsty\p{Lo}]) |.{1,40}", s)] or [""]
        leaves = [(sha(s), len(s)) for s in runs]
        h = sha(",".join(f"{a}.{n}" for a, n in leaves))
        open_.append(h[:16] + ":" + ",".join(f"{a[:12]}.{n}" for a, n in leaves))
        inside += h
        if p == "" or h[63] in "0123" or k == len(paragraphs) - 1:
            above += sha(inside)
            out.append(sha(inside)[:16] + "=" + ";".join(open_))
            open_, inside = [], ""
    return "|".join([sha(above), *out])


def plain_like(a, b):
    if a[:64] == b[:64]:
        return 1.0
    leaves = [set(re.findall(r"(?<![0-9a-f])[0-9a-f]{12}\.[0-9]+", x)) for x in (a, b)]
    weight = lambda s: sum(int(x.split(".")[1]) for x in s)
    both = weight(leaves[0]) + weight(leaves[1])
    return 2.0 * weight(leaves[0] & leaves[1]) / both if both else 0.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), sha(r[1] or "")))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        f, g = plain_tree(t), plain_tree(e)
        out.append((i, len(t), sha(e), f, g, plain_like(f, g), plain_like(f, plain_tree(nxt))))
    return sorted(out, key=str)


def table(n, seed=1):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choices(["Ab cd.", "ef", "g|", "ü𝒳y;", "a: b", "", "x" * 50, "?", "ends", "اردو", "y" * 130 + "."], k=rng.randrange(12)))
    rows = [(rng.choice([i * 7, i * 1000, i]), "\n".join(line() for _ in range(rng.randrange(9)))) for i in range(n)]
    return rows + [(5, None), (6, ""), (6, ""), (5, "dup id"), (2**60, "Z. " * 20_000), (-3, "neg"), (None, "none"), (None, "none 2")]


@pytest.mark.parametrize("size", [4096, 2, 25])
def test_equals_brute_force(docs, size):
    rows = table(150 if size > 2 else 400)
    got = merkle.fingerprint_edits(docs(rows), rows_per_block=size).collect()
    want = brute(rows)
    got = sorted(map(tuple, got), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_one_row_and_no_row(docs):
    assert [tuple(r) for r in merkle.fingerprint_edits(docs([(1, "abc def")])).collect()] == brute([(1, "abc def")])
    assert merkle.fingerprint_edits(docs([])).count() == 0


def test_differing_branches_locate_edits(spark):
    rng = random.Random(3)
    lines = [f"line {i} {rng.random()}. tail" for i in range(200)]
    edited = list(lines)
    for i in (17, 60, 199):
        edited[i] += " changed"
    edited.insert(100, "new")
    df = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    df = df.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    row = df.select(merkle.edited_paragraphs(F.col("a"), F.col("b")).alias("x"), merkle.likeness(F.col("a"), F.col("b")).alias("n"), merkle.same_text(F.col("a"), F.col("b")).alias("s")).first()
    assert list(row.x) == [17, 60, 100, 200] and 0.95 < row.n < 1 and not row.s


def test_texts_without_borders_share_what_was_kept(spark, docs):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdenst", k=rng.randrange(1, 9))) for _ in range(n))
    rows = [(i, words(rng.randrange(20, 200))) for i in range(60)]
    rows += [(100 + i, "".join(rng.choices("漢字假名交文", k=60 + 7 * i))) for i in range(30)]
    rows += [(200 + i, "".join(rng.choices("qwrp. ", k=60 + i))) for i in range(60)] + [(300, "z" * 60), (301, ""), (302, "z" * 40), (303, words(30_000))]
    got = [r for r in merkle.fingerprint_edits(docs(rows)).collect() if r.n_chars >= 60]
    assert len(got) > 150 and min(r.near_edited for r in got) > 0
    long = [r.near_edited for r in got if r.n_chars > 400 and r.doc_id < 100]
    assert long and min(long) > 0.4
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    none = merkle.fingerprint_edits(given).where("n_chars >= 60 and near_edited = 0")
    assert none.count() == 0


def test_cuts_do_not_hide_differences(spark):
    texts = ["x" * 39 + ". y", "x" * 39 + ".y", "x" * 39 + ".  y", "x" * 39 + ".\ny", "x" * 40 + "y", "x" * 40 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(merkle.fingerprint(F.col("t")).alias("f"))
    assert len({r.f[:64] for r in df.collect()}) == len(texts)


def test_plan_has_no_python(docs):
    plan = merkle.fingerprint_edits(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
