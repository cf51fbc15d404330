import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chalkline.llm import similar


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        d = similar.NULL_ID if d is None else d
        least[root(i)] = min(least.get(root(i), similar.NULL_ID), d)
    known = lambda x: None if x == similar.NULL_ID else x
    return sorted(((d, len(s), known(least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def table(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "The", "X"]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    hot = prose(12)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + rng.randrange(2)] = prose(rng.randrange(2))
        else:
            w = prose(rng.choice([0, 1, 2, 3, 6, 20, 60, 200]))
            if rng.random() < 0.5:
                w = w + hot
        rows.append((i * 2, " ".join(w)))
    base = prose(80)
    for i in range(60):  # one large group of near copies
        w = list(base)
        w[rng.randrange(80)] = f"n{i}"
        rows.append((1000 + i, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \t"), (2, rows[3][1]), (2, "other text of a repeated id here"), (None, rows[8][1]),
                   (None, "only here now then"), (5003, "w1 " * 3000), (5004, "w1 " * 2000), (-7, rows[-1][1].upper())]


@pytest.mark.parametrize("seed, k, num, den, group", [(1, 4, 85, 100, 256), (2, 5, 80, 100, 256), (3, 4, 85, 100, 3), (4, 2, 50, 100, 4), (6, 4, 85, 100, 100), (5, 3, 100, 100, 256)])
def test_equals_brute_force(docs, monkeypatch, seed, k, num, den, group):
    monkeypatch.setattr(similar, "GROUP", group)
    monkeypatch.setattr(similar, "WHOLE", 4_000_000 if group == 256 else 300)
    rows = table(seed)
    got = similar.similar_documents(docs(rows, 4), words=k, num=num, den=den).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, num, den)


def test_empty_table(docs):
    assert similar.similar_documents(docs([])).count() == 0
    assert [tuple(r) for r in similar.similar_documents(docs([(3, None)])).collect()] == [(3, 0, 3)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(85, 100), (80, 100), (50, 100), (95, 100)]))
def test_sets_that_link_meet(seed, threshold):
    rng = np.random.default_rng(seed)
    num, den = threshold
    n = int(rng.integers(1, 400))
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    gone, new = rng.integers(0, max(1, n // 5) + 1, 2)
    b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
    common = len(np.intersect1d(a, b))
    if not len(b) or den * common < num * (len(a) + len(b) - common):
        return
    either = np.union1d(a, b)
    for share in (0.0, 0.3, 0.9, 1.0):  # whatever tokens count as common
        levels = similar.Levels(num, den, either[rng.random(len(either)) < share])
        place, keys = levels.keys([a, b])
        assert set(keys[place == 0].tolist()) & set(keys[place == 1].tolist())


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(85, 100), (60, 100)]))
def test_group_search_finds_all(seed, threshold):
    rng = np.random.default_rng(seed)
    num, den = threshold
    pool = rng.integers(0, 2**40, 120, dtype=np.uint64)
    sets = []
    for _ in range(int(rng.integers(2, 25))):
        if sets and rng.random() < 0.7:
            s = np.union1d(rng.permutation(sets[int(rng.integers(len(sets)))])[int(rng.integers(3)) :], rng.choice(pool, int(rng.integers(0, 3))))
        else:
            s = np.unique(rng.choice(pool, int(rng.integers(1, 40))))
        if len(s):
            sets.append(s)
    links = similar.Group(sets, list(range(len(sets))), num, den).connect()
    label = list(range(len(sets)))

    def connect(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    true = []
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                true.append((i, j))
    assert set(links) <= {(a, b) for x, y in true for a, b in ((x, y), (y, x))}
    assert connect(links) == connect(true)


@pytest.mark.parametrize("num, den", [(80, 100), (85, 100)])
def test_unlike_sets_share_no_key(num, den):
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(2, 260, 4000)]
    place, keys = similar.Levels(num, den).keys(sets)
    pairs = np.unique(np.stack([keys, place.astype(np.uint64)], 1), axis=0)
    assert np.unique(pairs[:, 0], return_counts=True)[1].max() <= 2  # two by chance in 40 bits
    assert len(pairs) < 1.1 * sum(len(s) for s in sets)


def test_first_tokens_alone_lose_no_link(monkeypatch):
    monkeypatch.setattr(similar, "DEALS", 0)
    monkeypatch.setattr(similar, "RARE_DEALS", 0)
    test_sets_that_link_meet()


def test_unlike_sets_that_share_a_passage_do_not_meet():
    rng = np.random.default_rng(12)
    passages = [rng.integers(0, 2**63, 25, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, int(n), dtype=np.uint64), passages[i % 3]])) for i, n in enumerate(rng.integers(80, 260, 2000))]

    def longest(common):
        place, keys = similar.Levels(80, 100, common).keys(sets)
        pairs = np.unique(np.stack([keys, place.astype(np.uint64)], 1), axis=0)
        return np.unique(pairs[:, 0], return_counts=True)[1].max()

    assert longest(np.sort(np.concatenate(passages))) <= 5 < 20 < longest(None)


def test_levels_do_not_grow_with_calls():
    """A split of many slices asks for keys hundreds of times; the bands follow the sizes of the sets only."""
    levels = similar.Levels(85, 100)
    sets = [np.arange(n, dtype=np.uint64) for n in (1, 30, 400)]
    first = levels.keys(sets)
    bands = len(levels.top)
    for _ in range(400):
        again = levels.keys(sets)
    assert len(levels.top) == bands
    assert all((a == b).all() for a, b in zip(first, again))


def sent(monkeypatch):
    """Counts the sets that are sent to be searched."""
    counts, search = [], similar._search_groups

    def counted(rows, reps, wanted, *a):
        counts.append(wanted.count())
        return search(rows, reps, wanted, *a)

    monkeypatch.setattr(similar, "_search_groups", counted)
    return counts


def test_a_large_cluster_is_sent_a_few_times(docs, monkeypatch):
    """Near copies too many for one group: a set goes to its block and once to each other block, however many keys it has."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in range(rng.choice([1, 2, 4, 8])):
            w[rng.randrange(120)] = f"n{i}-{j}"
        rows.append((i, " ".join(w)))
    counts = sent(monkeypatch)
    monkeypatch.setattr(similar, "GROUP", 16)
    monkeypatch.setattr(similar, "WHOLE", 26_000)
    got = similar.similar_documents(docs(rows, 4), words=4, num=85, den=100).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 85, 100)
    assert 400 < sum(counts) <= 400 * 6


def test_unlike_sets_that_meet_are_not_sent(docs, monkeypatch):
    """Two texts that share a passage meet under its keys; their sketches tell that they can't link."""
    rng = random.Random(5)
    prose = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    rows = []
    for i in range(150):
        passage = prose(60)
        rows += [(2 * i + j, " ".join(prose(70) + passage)) for j in (0, 1)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(10)]
    counts = sent(monkeypatch)
    got = similar.similar_documents(docs(rows, 2), words=4, num=80, den=100).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 80, 100)
    assert sum(counts) == 20


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(85, 100), (50, 100), (20, 100)]))
def test_sketches_differ_no_more_than_sets(seed, threshold):
    rng = np.random.default_rng(seed)
    num, den = threshold
    a = np.unique(rng.integers(0, 2**63, int(rng.choice([1, 31, 33, 400, 6000])), dtype=np.uint64))
    b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, len(a))) :], rng.integers(0, 2**63, int(rng.integers(0, 2 * len(a))), dtype=np.uint64)]))
    data, width = similar.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
    x, y = (d.view(np.uint64).reshape(1, -1) for d in np.split(data, [width[0]]))
    differ, common = similar.apart(x, y), len(np.intersect1d(a, b))
    assert differ[0] <= len(a) + len(b) - 2 * common
    if den * common >= num * (len(a) + len(b) - common):
        assert similar.may_link(differ, np.array([len(a) + len(b)]), num, den).all()


def test_blocks_and_pairs_of_blocks_find_what_one_group_finds():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 90, dtype=np.uint64)
    sets = [np.union1d(rng.permutation(base)[int(rng.integers(0, 15)) :], rng.integers(0, 2**63, int(rng.integers(1, 12)), dtype=np.uint64)) for _ in range(90)]

    def components(links):
        label = list(range(len(sets)))
        for i, j in links:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    whole = components(similar.Group(sets, list(range(90)), 85, 100).connect())
    parts = [list(range(i, 90, 3)) for i in range(3)]
    links = [(p[i], p[j]) for p in parts for i, j in similar.Group([sets[x] for x in p], p, 85, 100).connect()]
    known = components(links)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        both = parts[a] + parts[b]
        found = similar.Group([sets[x] for x in both], [known[x] for x in both], 85, 100, [0] * 30 + [1] * 30).connect()
        assert all((i < 30) != (j < 30) for i, j in found)
        links += [(both[i], both[j]) for i, j in found]
    assert components(links) == whole and 1 < len(set(whole)) < 90


def test_dissimilar_rows_of_a_large_cluster(docs, monkeypatch):
    """The stage of the pipeline: one row a component, and sets sent a few times, for a cluster above one group."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in range(rng.choice([1, 2, 4, 8])):
            w[rng.randrange(120)] = f"n{i}-{j}"
        rows.append((i, " ".join(w)))
    counts = sent(monkeypatch)
    monkeypatch.setattr(similar, "GROUP", 16)
    monkeypatch.setattr(similar, "WHOLE", 20_000)
    kept = [r.doc_id for r in similar.keep_dissimilar(docs(rows, 4), words=5, num=80, den=100).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute(rows, 5, 80, 100)})
    assert 300 < sum(counts) <= 300 * 6
