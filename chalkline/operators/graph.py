"""G: the curriculum graph as two tables.

``nodes(label, id, props map<string,string>)`` and ``edges(src_label, src, rel, dst_label, dst,
props map<string,string>)`` from segment rows ``(book_id, grade, subject, position, ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.codes import parse_code, validate_code
from chalkline.functions.rows import posexplode_into
from chalkline.operators.ordered import carry_lag, in_order, position_chunk, top_n
from chalkline.session import stored

BLOOM = ["remember", "understand", "apply", "analyze", "evaluate", "create"]


def _keys() -> dict[str, Column]:
    number = F.col("chapter_number").cast("string")
    chapter = F.concat("book_id", F.lit("::ch"), F.coalesce(number, F.lit("None")))
    index = F.coalesce(F.col("segment_index").cast("string"), F.lit("None"))
    return {"chapter_key": chapter, "lesson_key": F.concat(chapter, F.lit("::L"), index)}


def _at(*more: Column) -> Column:
    """Place of a row in the corpus: books by name, then file order."""
    return F.struct("book_id", "position", *more)


def outcome_rows(segments: DataFrame) -> DataFrame:
    """Outcome codes of segments with node id. A code of another grade gets an id of its own book, so
    it cannot merge with the real one; a fused note is kept beside the bare code."""
    keyed = segments.withColumns(_keys())
    keep = ["book_id", "grade", "subject", "position", "lesson_key", "slo_descriptions"]
    raw = posexplode_into(keyed, keep, F.col("slo_codes"), "code_no", "raw").filter(F.trim("raw") != "")
    parsed = raw.withColumns(
        {"c": parse_code(F.col("raw")), "suspect": F.array_contains(validate_code(F.col("raw"), F.col("grade")), "GRADE_MISMATCH")}
    )
    return parsed.select(
        "book_id",
        "grade",
        "subject",
        "position",
        "lesson_key",
        "code_no",
        F.when(F.col("suspect"), F.concat("c.code", F.lit("@"), "book_id")).otherwise(F.col("c.code")).alias("node_id"),
        "c.code",
        F.coalesce(F.nullif("c.grade", F.lit("")), F.lit("?")).alias("code_grade"),
        F.coalesce(F.nullif("c.strand", F.lit("")), F.lit("?")).alias("strand"),
        "c.malformed",
        "c.fused_note",
        "suspect",
        F.coalesce(F.get("slo_descriptions", F.col("code_no")), F.lit("")).alias("description"),
    )


def _props(**columns: Column) -> Column:
    cells = [x for name, col in columns.items() for x in (F.lit(name), col.cast("string"))]
    return F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull())


def build_nodes(segments: DataFrame) -> DataFrame:
    """G1: Book, Chapter, Lesson, SLO, SkillType and Bloom nodes. The first chapter title and the
    first description of an outcome win; a repeated lesson key keeps its last row."""
    keyed = segments.withColumns(_keys())
    blank = F.lit("")
    books = keyed.groupBy("book_id").agg(
        F.first("grade").alias("grade"), F.first("subject").alias("subject"), F.count("*").alias("n")
    )
    chapters = keyed.groupBy("chapter_key").agg(
        F.first("book_id").alias("book"),
        F.first("chapter_number").alias("number"),
        F.min_by(F.coalesce("chapter_title", blank), _at()).alias("title"),
    )
    index = F.col("segment_index")
    kind = (
        F.when(index == 995, "assessment")
        .when((index == 990) | (F.col("new_or_revision") == "revision"), "revision")
        .otherwise("content")
    )
    body = _props(
        book=F.col("book_id"),
        grade=F.col("grade"),
        subject=F.col("subject"),
        chapter=F.col("chapter_number"),
        index=index,
        day_label=F.coalesce("day_label", blank),
        topic=F.coalesce("topic", blank),
        skill_type=F.coalesce("skill_type", blank),
        cpa_phase=F.coalesce("cpa_phase", blank),
        blooms=F.coalesce("blooms", blank),
        pages=F.array_join(F.transform(F.coalesce("pages_printed", F.array().cast("array<bigint>")), lambda p: p.cast("string")), ","),
        kind=kind,
        new_or_revision=F.coalesce("new_or_revision", blank),
    )
    # the struct, not the map, goes through the aggregate's ordering
    lessons = keyed.groupBy("lesson_key").agg(F.max_by(body, _at()).alias("props"))
    rows = outcome_rows(segments)
    first = F.struct("code", "code_grade", "strand", "malformed", "description", "book_id")
    slos = rows.groupBy("node_id").agg(
        F.min_by(first, _at(F.col("code_no"))).alias("f"),
        F.max("suspect").alias("suspect"),
        F.max_by(F.when(F.col("fused_note") != "", F.left("fused_note", F.lit(200))), F.struct(F.col("fused_note") != "", _at(F.col("code_no")))).alias("note"),
    )
    yes = F.lit("true")

    def node(df: DataFrame, label: str, ident: str, props: Column) -> DataFrame:
        return df.select(F.lit(label).alias("label"), F.col(ident).alias("id"), props.alias("props"))

    out = [
        node(books, "Book", "book_id", _props(grade=F.col("grade"), subject=F.col("subject"), n_lessons=F.col("n"))),
        node(chapters, "Chapter", "chapter_key", _props(book=F.col("book"), number=F.col("number"), title=F.col("title"))),
        node(lessons, "Lesson", "lesson_key", F.col("props")),
        node(
            slos,
            "SLO",
            "node_id",
            _props(
                code=F.col("f.code"),
                code_grade=F.col("f.code_grade"),
                strand=F.col("f.strand"),
                malformed=F.col("f.malformed"),
                description=F.col("f.description"),
                suspect_grade_mismatch=F.when(F.col("suspect"), yes),
                book=F.when(F.col("suspect"), F.col("f.book_id")),
                derived_somewhere=F.when(F.col("note").isNotNull(), yes),
                derivation_note=F.col("note"),
            ),
        ),
    ]
    for label, column in (("SkillType", "skill_type"), ("Bloom", "blooms")):
        values = keyed.filter(F.coalesce(column, blank) != "").select(column).distinct()
        out.append(node(values, label, column, F.create_map().cast("map<string,string>")))
    nodes = out[0]
    for df in out[1:]:
        nodes = nodes.unionByName(df)
    return nodes


def _edge(df: DataFrame, src_label: str, src: str, rel: str, dst_label: str, dst: str, props: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(src_label).alias("src_label"),
        F.col(src).alias("src"),
        F.lit(rel).alias("rel"),
        F.lit(dst_label).alias("dst_label"),
        F.col(dst).alias("dst"),
        (F.create_map().cast("map<string,string>") if props is None else props).alias("props"),
    )


def lesson_order(segments: DataFrame) -> DataFrame:
    """W6 over segments: each lesson linked to the next segment of its book, in file order."""
    keyed = segments.withColumns(_keys()).select("book_id", "position", "lesson_key")
    lagged = carry_lag(keyed, ["book_id"], ["position"], ["lesson_key"], position_chunk("position"))
    return lagged.filter(F.col("prev_lesson_key").isNotNull())


def build_edges(segments: DataFrame) -> DataFrame:
    """CONTAINS, TEACHES, HAS_SKILL, AT_BLOOM and PRECEDES edges."""
    keyed = segments.withColumns(_keys())
    blank = F.lit("")
    chapters = keyed.select("book_id", "chapter_key").distinct()
    out = [
        _edge(chapters, "Book", "book_id", "CONTAINS", "Chapter", "chapter_key"),
        _edge(keyed, "Chapter", "chapter_key", "CONTAINS", "Lesson", "lesson_key"),
        _edge(outcome_rows(segments), "Lesson", "lesson_key", "TEACHES", "SLO", "node_id"),
        _edge(keyed.filter(F.coalesce("skill_type", blank) != ""), "Lesson", "lesson_key", "HAS_SKILL", "SkillType", "skill_type"),
        _edge(keyed.filter(F.coalesce("blooms", blank) != ""), "Lesson", "lesson_key", "AT_BLOOM", "Bloom", "blooms"),
        _edge(lesson_order(segments), "Lesson", "prev_lesson_key", "PRECEDES", "Lesson", "lesson_key"),
    ]
    edges = out[0]
    for df in out[1:]:
        edges = edges.unionByName(df)
    return edges


# G3, G4 ----------------------------------------------------------------------------


def precedes_slo(teaches: DataFrame) -> DataFrame:
    """``teaches(book_id, strand, node_id, place)`` to a chain per book and strand: outcomes by
    first introduction, each linked to the next, numbered from 0."""
    first = teaches.groupBy("book_id", "strand", "node_id").agg(F.min("place").alias("place"))
    keys, order = ["book_id", "strand"], ["place", "node_id"]
    lagged = in_order(first, keys, order, 10_000, lag=["node_id"], number="_pos")
    return lagged.filter(F.col("prev_node_id").isNotNull()).select(
        "book_id", "strand", F.col("prev_node_id").alias("src"), F.col("node_id").alias("dst"), (F.col("_pos") - 2).alias("order")
    )


def outcome_places(outcomes: DataFrame) -> DataFrame:
    """Places of outcomes in their book for G3: the segment, then the place of the code in it."""
    return outcomes.select("book_id", "strand", "node_id", F.struct("position", "code_no").alias("place"))


def co_taught(lessons: DataFrame) -> DataFrame:
    """``lessons(book_id, codes array)`` to unordered pairs of codes of one lesson, once per book.

    The pairs are the result itself. Lessons with the same codes are merged first, so copies of a
    lesson add nothing; one lesson's codes sit in one row."""
    sets = lessons.select("book_id", F.sort_array(F.array_distinct("codes")).alias("codes")).distinct()
    firsts = sets.select("book_id", "codes", F.posexplode("codes").alias("i", "a"))
    rest = F.slice("codes", F.col("i") + 2, F.greatest(F.size("codes") - F.col("i") - 1, F.lit(0)))
    return firsts.select("book_id", "a", F.explode(rest).alias("b")).distinct()


def lesson_codes(outcomes: DataFrame) -> DataFrame:
    """Code arrays per segment for G4 (the codes of one segment row)."""
    return outcomes.groupBy("book_id", "position").agg(F.collect_set("node_id").alias("codes"))


# G5, G6 --------------------------------------------------------------------------------


def slo_meta(slos: DataFrame, teaches: DataFrame, lesson_bloom: DataFrame) -> DataFrame:
    """``slos(id, grade, strand, suspect)`` with the majority Bloom of the lessons that teach it
    (the first seen on ties). ``teaches(lesson, id, place)``, ``lesson_bloom(lesson, bloom)``."""
    counts = (
        teaches.join(lesson_bloom, "lesson")
        .groupBy("id", "bloom")
        .agg(F.count("*").alias("n"), F.min("place").alias("first_seen"))
    )
    major = counts.groupBy("id").agg(
        F.min_by("bloom", F.struct((-F.col("n")).alias("n"), "first_seen", "bloom")).alias("bloom")
    )
    return slos.join(major, "id", "left")


def bloom_rank(bloom: Column) -> Column:
    pairs = [x for i, name in enumerate(BLOOM) for x in (F.lit(name), F.lit(i))]
    return F.create_map(*pairs)[F.lower(F.trim(bloom))]


def orient_pairs(pairs: DataFrame, meta: DataFrame, max_gap: int = 2) -> DataFrame:
    """``pairs(a, b, weight)`` to directed (src, dst, method) or, where neither grade nor Bloom
    tells, candidates with a NULL method. Suspect outcomes, pairs of one strand and grade, and
    grades more than ``max_gap`` apart are left out."""
    side = lambda p: meta.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "grade", "strand", "suspect", "bloom")])
    joined = (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
        .join(side("a"), F.col("a") == F.col("a_id"))
        .join(side("b"), F.col("b") == F.col("b_id"))
        .filter(~F.col("a_suspect") & ~F.col("b_suspect"))
        .filter(~F.col("a_strand").eqNullSafe(F.col("b_strand")) | ~F.col("a_grade").eqNullSafe(F.col("b_grade")))
    )
    ga, gb = F.col("a_grade").try_cast("int"), F.col("b_grade").try_cast("int")
    near = joined.filter(F.coalesce(F.abs(ga - gb) <= max_gap, F.lit(True)))
    ra, rb = bloom_rank(F.col("a_bloom")), bloom_rank(F.col("b_bloom"))
    by_grade = F.coalesce(ga != gb, F.lit(False))
    by_bloom = F.coalesce(ra != rb, F.lit(False))
    swap = F.when(by_grade, ga > gb).when(by_bloom, ra > rb).otherwise(F.lit(False))
    return near.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("src"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("dst"),
        "weight",
        F.when(by_grade, "grade").when(by_bloom, "bloom").alias("method"),
    )


# G7 -----------------------------------------------------------------------------------------
#
# Edges under work are (a, b, r): from node a to node b, and the place r of an edge in the order of decisions. An edge
# may stand for a path; then r is that of its last edge, which alone can close a cycle that goes along the path.

#: edges of one strongly connected part that are decided together: bits of the sets of nodes they reach
BATCH = 1024


def _shrink_once(live: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """(edges left, edges found to close a cycle, whether anything changed), all by joins.

    Nodes without in- or out-edge lie on no cycle and go with their edges. Nodes with one of each are
    middles: paths of them become one edge, by pointers that double in each step, and rings of them lose their last
    edge. Two spans of a path that start one after the other share no node, so equal smallest nodes
    (``low``) tell that a ring has closed.
    """
    outward = live.select(F.col("a").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.struct("b", "r").alias("out"))
    inward = live.select(F.col("b").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = outward.unionByName(inward, allowMissingColumns=True).groupBy("node")
    ends = stored(
        ends.agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"), F.max("out").alias("out")).filter("ins = 0 OR outs = 0 OR ins = 1 AND outs = 1")
    )
    if ends.isEmpty():
        return live, None, False
    dead = ends.filter("ins = 0 OR outs = 0").select("node")
    middles = ends.filter("ins = 1 AND outs = 1").select(
        "node", F.col("out.b").alias("to"), F.col("out.r").alias("r"), F.col("node").alias("low"), F.lit(False).alias("ring"), F.lit(True).alias("open")
    )
    while not middles.filter("open").isEmpty():
        ahead = middles.select(
            F.col("node").alias("to"), F.col("to").alias("to2"), F.col("r").alias("r2"), F.col("low").alias("low2"), F.col("ring").alias("ring2")
        )
        ring = F.col("ring") | F.coalesce(F.col("ring2") | (F.col("low") == F.col("low2")), F.lit(False))
        middles = stored(
            middles.join(ahead, "to", "left").select(
                "node",
                F.coalesce("to2", "to").alias("to"),
                F.greatest("r", F.coalesce("r2", "r")).alias("r"),
                F.least("low", F.coalesce("low2", "low")).alias("low"),
                ring.alias("ring"),
                (F.col("to2").isNotNull() & ~ring).alias("open"),
            )
        )
    path = middles.select(F.col("node").alias("b"), "to", F.col("r").alias("path_r"))
    gone = ends.select(F.col("node").alias("a"))
    left = (
        live.join(gone, "a", "left_anti")
        .join(path, "b", "left")
        .select("a", F.coalesce("to", "b").alias("b"), F.greatest("r", F.coalesce("path_r", "r")).alias("r"))
        .join(dead.select(F.col("node").alias("b")), "b", "left_anti")
    )
    left = stored(left.select("a", "b", "r"))
    closing = middles.filter("ring AND node = low").select("r").unionByName(left.filter("a = b").select("r"))
    return left.filter("a <> b"), closing, True


def _shrink(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges left when every node lies between others, with at least three edges, and the edges found to close a cycle."""
    closing = live.select("r").limit(0)
    while True:
        live, found, changed = _shrink_once(live)
        if not changed:
            return live, closing
        closing = closing.unionByName(found)


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest node from which edges lead to each node, itself included; labels jump to the label
    of their label in each round."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(nodes.withColumn("least", F.col("node")))
    while True:
        near = edges.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("least").alias("near"))
        hop = labels.select(F.col("node").alias("least"), F.col("least").alias("hop"))
        moved = F.least("least", F.coalesce("near", "least"), F.coalesce("hop", "least"))
        labels = stored(
            labels.join(near, "node", "left").join(hop, "least", "left").select("node", moved.alias("least"), (moved != F.col("least")).alias("moved"))
        )
        if labels.filter("moved").isEmpty():
            return labels.drop("moved")


def strong_parts(live: DataFrame) -> DataFrame:
    """(a, b, r, part): the edges inside strongly connected parts, by colouring.

    A node's colour is the smallest node that leads to it. Nodes of a colour that lead back to
    that node are its part; edges between colours lie on no cycle; what is left of each colour is coloured again.
    """
    settled = None
    while not live.isEmpty():
        colour = _least_reaching(live)
        of = lambda side, name: colour.select(F.col("node").alias(side), F.col("least").alias(name))
        same = stored(live.join(of("a", "part"), "a").join(of("b", "other"), "b").filter("part = other").select("a", "b", "r", "part"))
        back = _least_reaching(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        home = lambda side, name: back.select(F.col("node").alias(side), F.col("least").alias(name))
        both = stored(same.join(home("a", "x"), "a").join(home("b", "y"), "b").filter("x = y").select("a", "b", "r", "part", (F.col("x") == F.col("part")).alias("done")))
        found = both.filter("done").drop("done")
        settled = found if settled is None else settled.unionByName(found)
        live = both.filter("NOT done").select("a", "b", "r")
    return settled if settled is not None else live.withColumn("part", F.col("a"))


def _reached(kept: DataFrame, batch: DataFrame, words: int) -> DataFrame:
    """(node, bits): for each node the batch edges from whose head decided edges lead to it, as ``words`` longs."""
    bit = [F.when(F.floor(F.col("i") / 64) == w, F.expr("shiftleft(1L, cast(i % 64 AS int))")).otherwise(F.lit(0).cast("long")) for w in range(words)]
    columns = [f"w{w}" for w in range(words)]
    merged = lambda df: df.groupBy("node").agg(*[F.bit_or(c).alias(c) for c in columns])
    state = stored(merged(batch.select(F.col("b").alias("node"), *[x.alias(c) for x, c in zip(bit, columns)])))
    size = sum(F.bit_count(c) for c in columns)
    known = -1
    while (total := state.agg(F.sum(size)).first()[0]) != known:
        known = total
        moved = kept.join(state, F.col("a") == F.col("node")).select(F.col("b").alias("node"), *columns)
        state = stored(merged(state.unionByName(moved)))
    return state.select("node", F.array(*columns).alias("bits"))


def _settle_batches(batches):
    """Decide batches: rows come by part and place ``i``. ``reach`` of edge j holds the batch edges from whose head its tail
    can be reached; it closes a cycle if it is one of them, and otherwise hands them on."""
    import pyarrow as pa

    def settle(rows):
        reach = [sum((w & (2**64 - 1)) << 64 * k for k, w in enumerate(bits or ())) for bits in (r["bits"] for r in rows)]
        heads: dict = {}
        for i, r in enumerate(rows):
            heads[r["b"]] = heads.get(r["b"], 0) | 1 << i
        reach = [x | heads.get(r["a"], 0) for x, r in zip(reach, rows)]
        for j in range(len(rows)):
            closes = bool(reach[j] >> j & 1)
            if not closes:
                mine = reach[j]
                for k in range(len(rows)):
                    if reach[k] >> j & 1:
                        reach[k] |= mine
            yield closes

    held: list = []
    out: list = []
    schema = None

    def flush():
        closes = list(settle(held))
        out.extend({"r": row["r"], "closes": c} for row, c in zip(held, closes))

    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if held and held[-1]["part"] != row["part"]:
                flush()
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([schema.field("r"), pa.field("closes", pa.bool_())]))
            out = []
    if held:
        flush()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([schema.field("r"), pa.field("closes", pa.bool_())]))


def _decide(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, edges that close a cycle): the next ``BATCH`` undecided edges of each part, heaviest first."""
    kept, rest = parts.filter("r.late = 0"), parts.filter("r.late = 1")
    batch = stored(top_n(rest, ["part"], [F.col("r").asc()], BATCH).withColumn("i", F.col("rank") - 1).drop("rank"))
    words = -(-(batch.agg(F.max("i")).first()[0] + 1) // 64)
    if kept.isEmpty():
        rows = batch.withColumn("bits", F.lit(None).cast("array<bigint>"))
    else:
        rows = batch.join(_reached(kept, batch, words), F.col("a") == F.col("node"), "left")
    rows = rows.select("part", "i", "a", "b", "r", "bits").repartition("part").sortWithinPartitions("part", "i")
    kind = parts.schema["r"].dataType.simpleString()
    told = stored(rows.mapInArrow(_settle_batches, f"r {kind}, closes boolean"))
    known = parts.join(told, "r", "left")
    place = F.when(F.col("closes").isNotNull(), F.col("r").withField("late", F.lit(0))).otherwise(F.col("r"))
    left = stored(known.filter("closes IS NULL OR NOT closes").select("a", "b", place.alias("r")))
    return left, told.filter("closes").select("r")


def _ordered(edges: DataFrame) -> DataFrame:
    """(a, b, r) of the pairs of two nodes; repeated pairs at their largest weight."""
    r = F.struct(F.lit(1).alias("late"), F.col("weight").isNull().alias("unknown"), (-F.col("weight")).alias("light"), "src", "dst")
    pairs = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.min(r).alias("r"))
    return stored(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "r"))


def acyclic_core(edges: DataFrame) -> DataFrame:
    """``edges(src, dst, weight)`` with ``kept``: heaviest first, an edge that closes a cycle of
    kept edges is dropped (ties by src, dst; without weight last). Rows that repeat a pair share its fate, at its
    largest weight; an edge from a node to itself is dropped.

    Edges on no cycle stay. The graph is shrunk by joins (``_shrink``), which decides chains and rings of any
    length in rounds that double. The rest is cut into strongly connected parts, and in each
    part the heaviest ``BATCH`` edges are decided together, then the next: sets of bits that spread over the edges kept so far
    tell which heads of the batch lead to which tails. A task holds the edges of one batch,
    whatever the size of the part; parts are decided side by side."""
    live, dropped = _ordered(edges), None
    while True:
        live, closing = _shrink(live)
        dropped = closing if dropped is None else dropped.unionByName(closing)
        if live.filter("r.late = 1").isEmpty():
            break
        live = strong_parts(live)
        if live.filter("r.late = 1").isEmpty():
            break
        live, closing = _decide(live)
        dropped = dropped.unionByName(closing)
    dropped = dropped.select("r.src", "r.dst", F.lit(False).alias("_kept"))
    loop = F.coalesce(F.col("src") == F.col("dst"), F.lit(False))
    return edges.join(dropped, ["src", "dst"], "left").withColumn("kept", F.coalesce("_kept", ~loop)).drop("_kept")


def has_cycle(edges: DataFrame) -> bool:
    """Whether any directed cycle exists."""
    if not edges.filter(F.col("src") == F.col("dst")).isEmpty():
        return True
    live, closing = _shrink(_ordered(edges.select("src", "dst", F.lit(0).alias("weight"))))
    return not live.isEmpty() or not closing.isEmpty()
