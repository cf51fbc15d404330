import hashlib
import random

from chalkline.llm.exact import exact_dedup, grace


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        known = [x for x in same if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "a", "a ", "A", "ü" * 9, "x" * 200_000, "long " * 50_000, f"own {i}"])) for i in range(300)]
    rows += [(None, "a"), (None, "only null id"), (7, rows[7][1])]
    got = exact_dedup(docs(rows), limit=300_000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(docs):
    assert exact_dedup(docs([])).count() == 0


def test_spills_recursively_and_compares_contents():
    rng = random.Random(2)
    texts = [bytes([i % 251]) * 1000 + str(i).encode() for i in range(400)]
    rows = [(rng.getrandbits(64) - 2**63 if k % 5 else 77, t, k, 1) for k, t in enumerate(texts)]  # a fifth shares one key
    rows = rows * 3
    rng.shuffle(rows)
    got = {t: (keep, n) for _, t, keep, n in grace(iter(rows), 20_000)}
    assert got == {t: (k, 3) for k, t in enumerate(texts)}
