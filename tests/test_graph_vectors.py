"""Graph and vector operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.operators import graph as G
from chalkline.operators import joins as J
from chalkline.operators import vectors as E
from chalkline.sources import sinks
from chalkline.sources.corpora import SEGMENT


def greedy(edges):
    after, kept = {}, {}
    for s, d, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        seen, stack, closes = set(), [d], s == d
        while stack and not closes:
            x = stack.pop()
            closes = x == s
            if x not in seen:
                seen.add(x)
                stack += after.get(x, [])
        kept[s, d] = not closes
        if not closes:
            after.setdefault(s, []).append(d)
    return kept


@pytest.mark.parametrize("seed,nodes,n", [(1, 12, 40), (2, 30, 45), (3, 6, 5)])
def test_acyclic_core(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = {}
    while len(edges) < n:
        edges[rng.randrange(nodes), rng.randrange(nodes)] = float(rng.randrange(10))
    rows = [(s, d, w) for (s, d), w in edges.items()]
    out = G.acyclic_core(spark.createDataFrame(rows, "src int, dst int, weight double"))
    assert {(r["src"], r["dst"]): r["kept"] for r in out.collect()} == greedy(rows)
    assert not G.has_cycle(out.filter("kept").select("src", "dst"))


def test_chain_has_no_core(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "src int, dst int, weight double")
    assert G.acyclic_core(chain).filter("kept").count() == 9 and not G.has_cycle(chain)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    plain = G.stored
    monkeypatch.setattr(G, "stored", lambda df: calls.append(1) or plain(df))
    n = 10_000
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS weight")
    ring = spark.createDataFrame([(n, n + 1, 3.0), (n + 1, n + 2, 1.0), (n + 2, n, 2.0)], "src long, dst long, weight double")
    out = G.acyclic_core(chain.union(ring))
    assert [(r.src, r.dst) for r in out.filter("NOT kept").collect()] == [(n + 1, n + 2)]
    assert len(calls) < 25  # doubling steps, not layers


@pytest.mark.parametrize("seed, nodes, n, batch", [(5, 9, 60, 30)])
def test_parts_beyond_one_batch(spark, monkeypatch, seed, nodes, n, batch):
    monkeypatch.setattr(G, "BATCH", batch)  # several batches a part: kept edges carry reach between them
    rng = random.Random(seed)
    edges = {}
    while len(edges) < n:
        edges[f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}"] = float(rng.randrange(30))
    rows = [(s, d, w) for (s, d), w in edges.items()]
    out = G.acyclic_core(spark.createDataFrame(rows, "src string, dst string, weight double"))
    assert {(r["src"], r["dst"]): r["kept"] for r in out.collect()} == greedy(rows)


def test_odd_edges(spark):
    rows = [("a", "b", 1.0), ("b", "a", None), ("a", "a", 5.0), (None, "a", 1.0), ("c", "d", 2.0), ("c", "d", 9.0), ("d", "c", 3.0)]
    out = G.acyclic_core(spark.createDataFrame(rows, "src string, dst string, weight double")).collect()
    got = {(r["src"], r["dst"], r["weight"]): r["kept"] for r in out}
    assert got == {r: r not in {("b", "a", None), ("a", "a", 5.0), ("d", "c", 3.0)} for r in rows}
    assert G.acyclic_core(spark.createDataFrame([], "src string, dst string, weight double")).count() == 0


def make_segments(spark):
    rows = []
    for i in range(1, 13):
        chapter = 1 if i < 8 else 2
        strand = "NS" if i % 2 else "WR"
        rows.append(
            (
                "grade_2_math", "2", "math", i - 1, 995 if i == 12 else i, "", chapter, f"Chapter {chapter} v{i}", f"Topic {i}",
                "skill", None, [i], [f"M-02-{strand}-{i % 4:02d}", "M-02-NS-01", "U-05-CO-01", " "], [f"desc {i}"], "apply" if i % 3 else "create",
                "revision" if i == 5 else None,
            )
        )
    schema = (
        "book_id string, grade string, subject string, position int, segment_index int, day_label string, chapter_number int, chapter_title string, "
        "topic string, skill_type string, cpa_phase string, pages_printed array<int>, slo_codes array<string>, slo_descriptions array<string>, blooms string, new_or_revision string"
    )
    return spark.createDataFrame(rows, schema)


def test_graph_shape(spark):
    segments = make_segments(spark)
    nodes = {(r["label"], r["id"]): r["props"] for r in G.build_nodes(segments).collect()}
    assert sum(label == "Lesson" for label, _ in nodes) == 12
    assert nodes["Chapter", "grade_2_math::ch1"]["title"] == "Chapter 1 v1"
    assert nodes["Lesson", "grade_2_math::ch2::L995"]["kind"] == "assessment"
    suspect = nodes["SLO", "U-05-CO-01@grade_2_math"]
    assert suspect["suspect_grade_mismatch"] == "true" and suspect["book"] == "grade_2_math"
    rels = {}
    for r in G.build_edges(segments).collect():
        rels[r["rel"]] = rels.get(r["rel"], 0) + 1
    assert rels == {"CONTAINS": 14, "TEACHES": 36, "HAS_SKILL": 12, "AT_BLOOM": 12, "PRECEDES": 11}
    outcomes = G.outcome_rows(segments)
    chain = G.precedes_slo(G.outcome_places(outcomes)).collect()
    assert sorted((r["strand"], r["order"]) for r in chain) == [("NS", 0), ("WR", 0)]
    pairs = {(r["a"], r["b"]) for r in G.co_taught(G.lesson_codes(outcomes)).collect()}
    assert ("M-02-NS-01", "U-05-CO-01@grade_2_math") in pairs and all(a < b for a, b in pairs)


def test_orientation(spark):
    meta = spark.createDataFrame(
        [("a", "01", "X", False, "apply"), ("b", "03", "X", False, None), ("c", "01", "Y", False, "create"), ("d", "?", "Y", False, None), ("e", "01", "Z", True, None), ("f", "04", "Q", False, None)],
        "id string, grade string, strand string, suspect boolean, bloom string",
    )
    pairs = spark.createDataFrame([("b", "a", 1.0), ("c", "a", 1.0), ("d", "a", 1.0), ("e", "a", 1.0), ("a", "f", 1.0)], "a string, b string, weight double")
    got = {(r["src"], r["dst"], r["method"]) for r in G.orient_pairs(pairs, meta).collect()}
    assert got == {("a", "b", "grade"), ("a", "c", "bloom"), ("a", "d", None)}


# exports ------------------------------------------------------------------------------


def test_exports(spark, tmp_path):
    segments = make_segments(spark)
    nodes, edges = G.build_nodes(segments), G.build_edges(segments)
    ghost = edges.limit(1).withColumn("dst", F.lit("nowhere"))
    edges = edges.unionByName(ghost)
    import json
    import xml.etree.ElementTree as ET

    json_lines = [json.loads(r["line"]) for r in sinks.graph_lines(nodes, edges, "json").collect()]
    assert sum("rel" in x for x in json_lines) == 85
    sinks.export_graph(nodes, edges, str(tmp_path / "g"), "graphml")
    parts = sorted((tmp_path / "g").glob("part-*"))
    tree = ET.fromstring("".join(p.read_text() for p in parts))
    graph = tree.find("{http://graphml.graphdrawing.org/xmlns}graph")
    assert len(graph.findall("{http://graphml.graphdrawing.org/xmlns}edge")) == 85
    cypher = [r["line"] for r in sinks.graph_lines(nodes, edges, "cypher").collect()]
    assert any(x.startswith('MERGE (n:Book {id:"grade_2_math"}) SET n += {') for x in cypher)


# vectors ---------------------------------------------------------------------------------


def brute_mutual(ids, v, k, thr):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(v @ v.T, 9)
    top = []
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[i, j], ids[j]))
        top.append(set(order[:k]))
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in top[i] if i in top[j] and cos[i, j] >= thr}


@pytest.mark.parametrize("k,thr,block", [(3, 0.86, 8), (1, 0.92, 16), (15, 0.5, 7), (4, 0.9, None)])
def test_mutual_knn(spark, k, thr, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    v = np.concatenate([centres[rng.integers(6, size=90)] + rng.normal(scale=0.35, size=(90, 8)), np.tile(centres[0], (40, 1))])
    ids = list(range(100, 100 + len(v)))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v)], "id int, embedding array<float>")
    exact = np.array([r["embedding"] for r in df.orderBy("id").collect()])
    got = {(r["a"], r["b"]) for r in E.mutual_knn(df, k, thr, block=block).collect()}
    assert got == brute_mutual(ids, exact, k, thr)


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_few_pairs_are_multiplied_twice(kind, monkeypatch):
    """In 64 directions that matter alike, a bound from some of them excludes no pair; a rough product does."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    if kind == "clustered":
        v[:1500] = v[0] + 0.05 * v[:1500]
    if kind == "copies":
        v[:1500] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    twice, cosines = [], E._cosines
    monkeypatch.setattr(E, "_cosines", lambda a, b, row, col: twice.append(len(row)) or cosines(a, b, row, col))
    for a, b, same in ((v, v, True), (v[:1000], v[1000:], False)):
        cos = np.round(a @ b.T, E.DIGITS) + 0.0
        if same:
            np.fill_diagonal(cos, -2)
        want = {i: [(j, cos[i, j]) for j in np.lexsort((np.arange(len(b)), -cos[i]))[:15].tolist() if cos[i, j] >= 0.3] for i in range(len(a))}
        got = {i: [] for i in range(len(a))}
        for row, col, value in E._near(a, b, 15, 0.3, same):
            for i, j, c in zip(row.tolist(), col.tolist(), value.tolist()):
                got[i].append((j, c))
        assert {i: [j for j, _ in sorted(x, key=lambda y: (-y[1], y[0]))] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert sum(twice) < 0.03 * (len(v) ** 2 + 1000 * 2000)
    if kind == "random":
        assert sum(twice) > 0


def test_neighbours_keep_copies_and_leave_odd_vectors_out(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(50, [0.0, 0.0]), (51, None), (52, []), (53, [1.0, None]), (54, [float("nan"), 1.0]), (55, [1.0, 0.0, 0.0]), (56, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = {}
    for r in E.neighbours(df, 3, 0.9, block=10).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    want = {i: [(n + 1, o, 1.0) for n, o in enumerate([x for x in range(5) if x != i][:3])] for i in range(50)}
    assert {i: sorted(x) for i, x in got.items()} == want | {55: [(1, 56, 1.0)], 56: [(1, 55, 1.0)]}
    assert E.neighbours(df.filter("id = 51"), 3, 0.9).count() == 0


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_blocks_are_sent_to_few_pairs(spark, kind):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(12_000, 16))
    if kind == "clustered":
        v = rng.normal(size=(40, 16))[rng.integers(40, size=len(v))] + 0.1 * v
    if kind == "copies":
        v[:4000] = v[0]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "embedding": list(v)}), "id long, embedding array<double>")
    unit = E.unit_rows(df, "id", "embedding")
    placed, routes = E.block_routes(unit, len(v), 16, 0.86)
    assert placed.join(routes, "block").count() < 5 * len(v)
    sizes = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert sum(sizes) == len(v) and max(sizes) <= 2 * len(v) / 4 + 500
    if kind == "clustered":  # cells too far apart for the threshold do not meet
        _, fine = E.block_routes(unit, len(v), 16, 0.86, block=300)
        blocks = fine.select("block").distinct().count()
        assert fine.select("low", "high").distinct().count() < 0.7 * blocks * (blocks + 1) / 2


@pytest.mark.parametrize("blocks", [1, 5])
def test_cosine_profile(spark, blocks):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(40, 5)), np.ones((7, 5))])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    flat = (u @ u.T)[np.triu_indices(len(v), 1)]
    row = E.cosine_profile(df, blocks=blocks).first()
    assert row["pairs"] == len(flat)
    for name, want in (("min", flat.min()), ("median", np.median(flat)), ("p95", np.percentile(flat, 95)), ("max", flat.max())):
        assert row[name] == pytest.approx(want, abs=2e-6)


def test_vector_search_edges(spark):
    df = spark.createDataFrame(
        [("a", "r", "x.js", [1.0, 0.0]), ("b", "r", "x.py", [0.0, 0.0]), ("c", "r", "y.js", [1.0, 1.0, 1.0]), ("d", "s", "z.js", None)],
        "id string, repo_key string, file_path string, embedding array<double>",
    )
    got = {r["id"]: r["score"] for r in E.vector_search(df, [1.0, 0.0], min_score=0.0).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert [r["id"] for r in E.vector_search(df, [1.0, 0.0], repo="r", file_type="js", min_score=0.5).collect()] == ["a"]
    assert E.vector_search(df, []).count() == 0
    left = E.delete_chunks(E.upsert(df.withColumn("indexed_at", F.lit(1)), df.filter("id = 'a'").withColumns({"repo_key": F.lit("t"), "indexed_at": F.lit(2)})), "r", "x.py")
    assert {r["repo_key"]: r["chunks"] for r in E.store_stats(left).collect()} == {"t": 1, "r": 1, "s": 1}


# names --------------------------------------------------------------------------------------


def test_fuzzy_match_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))
    roster = [(i, rng.choice("PQ"), word(), rng.choice([None, "", word()]), i) for i in range(60)]
    heard = [(i, rng.choice("PQR"), word() + rng.choice(["", " " + word()])) for i in range(80)]
    r = spark.createDataFrame(roster, "student_id int, class_id string, student_name string, father_name string, position int")
    n = spark.createDataFrame(heard, "name_id int, class_id string, name string")

    def score(a, b):
        if a == b:
            return 1.0
        if a in b:
            return 0.7 + len(a) / len(b) * 0.3
        if b in a:
            return 0.7 + len(b) / len(a) * 0.3
        ga, gb = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
        return 2 * len(ga & gb) / (len(ga) + len(gb)) if ga and gb else 0.0

    want = {}
    for i, cls, name in heard:
        best, student = 0.0, None
        for sid, c, first, father, _ in roster:
            if c == cls:
                s = max(score(name, first), score(name, f"{first} {father}") if father else 0)
                if s > best and s > 0.4:
                    best, student = s, sid
        want[i] = (student, round(best, 9) if student is not None else 0.5 if cls == "R" else 0.3)
    got = {x["name_id"]: (x["student_id"], round(x["confidence"], 9)) for x in J.fuzzy_match(n, r).collect()}
    assert got == want


def test_segment_schema_parses():
    from pyspark.sql import types as T

    assert len(T.StructType.fromDDL(SEGMENT).fields) == 18


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_fuzzy_match_meets_equal_roster_texts_once(spark):
    """Copies of a roster name give one row a text, not one a copy, before they meet the scores; the first place wins."""
    n = spark.createDataFrame([(1, "c", "amina bibi")], "name_id int, class_id string, name string")
    r = spark.createDataFrame(
        [(i, "c", "amina bibi", None, 100 - i) for i in range(90)], "student_id int, class_id string, student_name string, father_name string, position int"
    )
    out = J.fuzzy_match(n, r)
    assert [(x["student_id"], x["confidence"]) for x in out.collect()] == [(89, 1.0)]
    assert "max(struct(early" in plan_of(out)


def test_topic_search_does_not_broadcast_stems(spark, tmp_path):
    """The stems of all titles are many times what the optimizer takes them for."""
    topics = spark.createDataFrame([(1, "m", "Fractions"), (2, "m", "zz")], "topic_id int, curriculum string, topic string")
    toc = spark.createDataFrame(
        [("m", g, c, "All about fractions", ["numbers"]) for g in (3, 2) for c in (9, 4)],
        "curriculum string, grade int, chapter_number int, chapter_title string, keywords array<string>",
    )
    for name, df in (("topics", topics), ("toc", toc)):  # files have a size, which a broadcast goes by
        df.write.parquet(f"{tmp_path}/{name}")
    out = J.topic_to_chapter(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("topics", "toc")])
    assert [(x["topic_id"], x["grade"], x["chapter_number"]) for x in out.collect()] == [(1, 2, 4)]
    joins = [line for line in plan_of(out).splitlines() if "_stem" in line and "Join" in line and "curriculum" in line]
    assert joins and not any("BroadcastHashJoin" in line for line in joins)
