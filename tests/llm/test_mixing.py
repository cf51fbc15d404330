import random
import re
from collections import defaultdict

import numpy as np
import pytest
from plain import targets_by_rounds

from chalkline.llm import mixing


def table(seed, n=400):
    rng = random.Random(seed)
    sizes = [0, 1, 5, 5, 5, 40, 300, 2000]
    return [(i, rng.choice([None, "", " \t"]) if not (k := rng.choice(sizes)) else "w " * (k + i % 3), None, rng.choice(["b", "a", "é", "A", None, "a "])) for i in range(n)]


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("cell", [10_000, 5])
def test_targets_and_copies(docs, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    rows = table(3) + [(1_000, "w w", None, "solo"), (1_001, "", None, "empty")]
    got = mixing.mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    total = defaultdict(int)
    for _, t, _, s in rows:
        total[s] += size(t)
    want = targets_by_rounds(total)
    by_id = {r[0]: r for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id][3]
        assert r["size"] == size(by_id[r.doc_id][1]) and r.source_size == total[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        assert 0 <= r.rate <= 2
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 3 or s == "solo", (s, taken[s], want[s])


def test_rates_solve_the_dual(docs):
    rows = table(5)
    got = mixing.mix_sources(docs(rows)).toPandas()
    got["source"] = got.doc_id.map({r[0]: r[3] or "null" for r in rows})
    for _, g in got.groupby("source"):
        assert np.dot(g["rate"], g["size"]) == pytest.approx(g.target.iloc[0], rel=1e-4)
        tilted = g[(g["size"] > 0) & (g.rate < 2)]
        tilt = np.log(tilted.rate / (2 - tilted.rate)) / tilted["size"]  # one number a source: exponential tilting
        if len(tilted):
            assert tilt.max() - tilt.min() < 1e-6


def test_reruns_agree_whatever_the_partitions(docs):
    rows = table(9)
    a = sorted(map(tuple, mixing.mix_sources(docs(rows, 1)).select("doc_id", "taken").collect()))
    random.Random(1).shuffle(rows)
    assert a == sorted(map(tuple, mixing.mix_sources(docs(rows, 5)).select("doc_id", "taken").collect()))


def test_empty_and_wordless(docs):
    assert mixing.mix_sources(docs([])).count() == 0
    got = mixing.mix_sources(docs([(1, None, None, None), (1, "", None, "a"), (None, " ", None, "a")])).collect()
    assert len(got) == 3 and all(r.taken == 0 and r.target == 0 for r in got)


def test_exchange_reaches_what_few_moves_can():
    # five documents, each none to two times
    size, top = np.array([785, 377, 342, 252, 235]), np.full(5, 2)
    for k in ([2, 0, 2, 2, 1], [0, 2, 2, 2, 2], [2, 1, 1, 1, 1]):
        left = 3191.26 - float((mixing.exchange(size, np.array(k), top, 3191.26 - float((np.array(k) * size).sum())) * size).sum())
        assert abs(left) <= 6
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = np.sort(rng.integers(1, 900, 12))[::-1]
        n = rng.integers(1, 4, 12)
        k, target = rng.integers(0, 2 * n + 1), float(rng.integers(0, int(2 * (n * size).sum())))
        out = mixing.exchange(size, k, 2 * n, target - float((k * size).sum()))
        left = target - float((out * size).sum())
        assert ((out >= 0) & (out <= 2 * n)).all() and abs(left) <= abs(target - float((k * size).sum()))
        moves = [(i, d) for i in range(12) for d in (1, -1) if 0 <= out[i] + d <= 2 * n[i]]
        for i, d in moves:
            assert abs(left) <= abs(left - d * size[i]) + 1e-9 or abs(left) <= 0.5
            for j, e in moves:
                assert i == j or abs(left) <= abs(left - d * size[i] - e * size[j]) + 1e-9 or abs(left) <= 0.5
