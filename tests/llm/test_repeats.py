import hashlib
import random
import re

import pytest

from chalkline.llm import repeats


def brute(rows, k):
    key = lambda i: repeats.NULL_ID if i is None else i
    first, words = {}, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append(w)
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, (key(i), s)), (key(i), s))
    out = []
    for (i, _), w in zip(rows, words):
        keep = [True] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (key(i), s):
                keep[s : s + k] = [False] * k
        kept = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["ü", "the", "é𝒳"]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [prose(rng.randrange(15, 70)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = prose(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(w) + 1), rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            w[at:at] = p[a:]
        rows.append((i * 3, "".join(x + rng.choice([" ", "\n", "\t ", "\x0b"]) for x in w)))
    rows += [(1000, None), (1001, ""), (1002, "same " * 300), (1003, "a b " * 200), (3, rows[5][1]), (3, rows[1][1]), (3, rows[1][1])]
    return rows + [(None, rows[7][1]), (None, rows[7][1] + " tail"), (-5, rows[9][1]), (1004, " ".join("xyz" * 40))]


@pytest.mark.parametrize("seed, k", [(1, 20), (2, 20), (3, 5), (4, 50), (5, 1)])
def test_equals_brute_force(docs, seed, k):
    rows = table(seed)
    got = repeats.remove_repeats(docs(rows, 5), window=k).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_cover_property():
    for v, cover in repeats.COVERS.items():
        for i in range(v):
            for j in range(v):
                assert any((i + d) % v in cover and (j + d) % v in cover for d in range(v))


def test_empty_table(docs):
    assert repeats.remove_repeats(docs([])).count() == 0


def test_other_rows_are_noticed(docs):
    from pyspark.sql import functions as F

    unsteady = F.udf(lambda i: random.random() < 0.5, "boolean").asNondeterministic()
    df = docs([(i, "a b c " * 20) for i in range(60)])
    with pytest.raises(Exception, match="other rows"):
        repeats.remove_repeats(df.where(unsteady("doc_id"))).collect()
