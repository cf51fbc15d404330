import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from chalkline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        told = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, told, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        made = own.get(head, [])[:h] + ts[h:]
        for d in range(len(made) + 1):
            members.setdefault(tuple(made[:d]), []).append(c)
        ends.setdefault(tuple(made), []).append(c)
    kids, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in sorted(members, key=len, reverse=True):
        if not kids[k]:
            leaves[k] = 1
        if k:
            saved[k] += (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1]))
            up = k[:-1]
            kids[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items()), key=str
    )


def made(seed, n):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", None, ""]), rng.choice(["a b c", "", None, "über\x0bx", f"t{i} w w"])) for i in range(12)]
    paths = [[rng.choice(turns) for _ in range(rng.randrange(1, 40))] for _ in range(8)]
    rows = []
    for c in range(-60, n):
        path = rng.choice(paths)[: rng.randrange(1, 40)] if rng.random() < 0.7 else paths[0]  # a third are one path
        if rng.random() < 0.2:
            path = path + [("user", f"own {c}")]
        rows += [(c, None if k == 0 and c % 3 == 0 else k, *t) for k, t in enumerate(path)]
    rows += [(None, 0, "user", "lost"), (500_000, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "b", "tie 2")]
    rows += [(900_000, k, "user", f"very long {k % 7}") for k in range(3000)] + [(900_001, k, "user", f"very long {k % 7}") for k in range(3001)]
    rows += [(1_000_021, 0, "user", "word " * 50_000)]
    rng.shuffle(rows)
    return rows


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed, shard", [(1, 8 << 20), (2, 4096)])
def test_equals_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(trie, "SHARD", shard)  # small shards: borders cut every path, over several levels
    rows = made(seed, 300)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS data", "3 AS n_convs", "4 AS key").repartition(5)
    assert collected(trie.prefix_trie(df)) == brute(rows)


def test_equal_conversations_fall_into_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 2000)
    rows = [(c, k, "user", f"same {k}") for c in range(0, 40_000, 20) for k in range(3)]
    assert collected(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_turnless_and_empty(spark):
    # conversation 3 takes over its first turns from a head that is absent
    c = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 4 > 0)
    got = collected(trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)))
    assert got == brute([(c, 0, "user", "x")]) and len(got) == 1
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_sort_rows_equals_sorted_lists():
    rng = random.Random(4)
    rows = [[rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 5, 16, 17, 32, 60]))] for _ in range(400)]
    rows += [rows[0]] * 30 + [[1] * 100] * 3 + [[1] * 99]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tie = np.array(rng.sample(range(10_000), len(rows)))
    order, common = trie.sort_rows(np.array([x for r in rows for x in r], np.int32), at, tie)
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], tie[i]))
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
