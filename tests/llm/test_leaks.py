import hashlib
import random
import re

import pytest

from chalkline.llm import leaks

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k):
    found = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - k, 0) + 1) if w else ():
            found.setdefault(tuple(w[s : s + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit, its = [False] * len(w), set()
        for size in {len(x) for x in found}:
            for s in range(len(w) - size + 1):
                mine = found.get(tuple(w[s : s + size]))
                if mine:
                    its |= mine
                    hit[s : s + size] = [True] * size
        out.append((i, len(w), sum(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["ü", "The", "é𝒳", "x y", "A1b"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    glue = lambda w: "".join(x + rng.choice([" ", "\n", ", ", "\x0b", "--", "\x00", "_"]) for x in w)
    items = [(i, glue(prose(rng.randrange(11, 40)))) for i in range(20)]
    items += [(50, "w1 w2 w3"), (51, "ü"), (52, "zebra"), (53, None), (54, ""), (55, " ,. "), (56, "a b"), (None, glue(prose(14))), (3, items[4][1]), (60, items[5][1])]
    items += [(i, items[0][1]) for i in range(100, 140)]  # many items share their windows
    rows = []
    for i in range(150):
        w = prose(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            x = words(rng.choice(items)[1])
            a = rng.randrange(len(x) + 1)
            w[rng.randrange(len(w) + 1) :] += x[a:] if rng.random() < 0.5 else x
        rows.append((i, glue(w).rstrip()))
    x = words(items[0][1])
    rows += [(200, None), (201, ""), (202, " ".join(x[:9])), (202, " ".join(x)), (None, "ab " + items[0][1].upper()), (203, " ".join(prose(50_000) + x))]
    rows += [(300 + i, items[0][1]) for i in range(60)]
    rows += [(400, " ".join(x[:5])), (401, " ".join(x[5:]))]  # a window that two rows share is none
    return rows, items


@pytest.mark.parametrize("seed, k, block", [(1, 10, 1 << 18), (2, 10, 50), (3, 2, 1 << 18), (4, 1, 30)])
def test_equals_brute_force(spark, docs, monkeypatch, seed, k, block):
    monkeypatch.setattr(leaks, "BLOCK", block)
    rows, items = made(seed)
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window", "2 AS item").repartition(3)
    got = leaks.find_leaks(docs(rows, 4).selectExpr("*", "9 AS n_hit", "'z' AS id"), table, window=k).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items, k)


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaks.find_leaks(docs([]), items).count() == 0
    for empty in (items.where("item_id > 1"), spark.createDataFrame([(1, None), (2, "?")], "item_id long, text string")):
        got = leaks.find_leaks(docs([(1, "a b c"), (2, None)]), empty).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [(1, 3, 0, False), (2, 0, 0, False)]
