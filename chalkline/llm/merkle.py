"""Document fingerprints: a hash tree over sections, paragraphs and runs of sentences, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: sentences end here: after a space that follows one of these characters a paragraph is cut
SENTENCE = r"(?<=[.!?|;:] )"
#: a sentence is cut into runs of 16 to 40 characters that end at a space after one of these letters, so that
#: an edit moves only the cuts near it; without such a space a run has 40 characters
RUN = r"(?s).{15,39}? (?<=[dnsty\p{Lo}] )|.{1,40}"
LEAF = r"(?<![0-9a-f])[0-9a-f]{12}\.[0-9]+"


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _runs(paragraph: Column) -> Column:
    """The leaves of a paragraph, which joined are the paragraph again; an empty one has one empty leaf."""
    runs = F.flatten(F.transform(F.split(paragraph, SENTENCE, -1), lambda s: F.regexp_extract_all(s, F.lit(RUN), F.lit(0))))
    return F.when(paragraph == "", F.array(F.lit(""))).otherwise(runs)


def fingerprint(text: Column) -> Column:
    """The tree of a text as one string; equal for equal texts, and different for different ones.

    ``root|section|section...``; a section is ``hash=paragraph;paragraph...``, a paragraph
    ``hash:leaf,leaf...``, a leaf ``hash.length`` for a run of at most 40 characters of a sentence, so the
    first 40 characters of a text hold a whole leaf whatever follows them. Paragraphs are lines. A section
    ends with a blank paragraph, or with one whose hash says so (a quarter of them), so that an
    edit moves no border but its own. Each node hashes its children; the root keeps 64 hex digits,
    the other nodes are shown by their first 16 or 12. Null counts as empty.
    """
    whole = F.coalesce(text, F.lit(""))
    leaves = F.transform(
        F.split(whole, "\n", -1),
        lambda p: F.transform(_runs(p), lambda s: F.concat(_sha(s), F.lit("."), F.length(s).cast("string"))),
    )
    short = lambda leaf: F.concat(F.substring(leaf, 1, 12), F.lit("."), F.substring_index(leaf, ".", -1))
    paragraphs = F.transform(
        leaves,
        lambda ls: F.struct(
            _sha(F.array_join(ls, ",")).alias("hash"),
            F.array_join(F.transform(ls, short), ",").alias("shown"),
            ((F.size(ls) == 1) & F.get(ls, F.lit(0)).endswith(".0")).alias("blank"),
        ),
    )
    none = F.expr("cast(array() AS array<string>)")
    start = F.struct(
        none.alias("out"), F.lit("").alias("above"), none.alias("open"), F.lit("").alias("inside")
    )

    def close(acc: Column) -> Column:
        section = _sha(acc["inside"])
        shown = F.concat(F.substring(section, 1, 16), F.lit("="), F.array_join(acc["open"], ";"))
        return F.struct(
            F.concat(acc["out"], F.array(shown)).alias("out"),
            F.concat(acc["above"], section).alias("above"),
            none.alias("open"),
            F.lit("").alias("inside"),
        )

    def step(acc: Column, p: Column) -> Column:
        more = F.struct(
            acc["out"].alias("out"),
            acc["above"].alias("above"),
            F.concat(acc["open"], F.array(F.concat(F.substring(p["hash"], 1, 16), F.lit(":"), p["shown"]))).alias("open"),
            F.concat(acc["inside"], p["hash"]).alias("inside"),
        )
        return F.when(p["blank"] | F.substring(p["hash"], 64, 1).isin("0", "1", "2", "3"), close(more)).otherwise(more)

    def finish(acc: Column) -> Column:
        return F.concat_ws("|", _sha(acc["above"]), acc["out"])

    return F.aggregate(paragraphs, start, step, lambda acc: finish(F.when(F.size(acc["open"]) > 0, close(acc)).otherwise(acc)))


def same_text(a: Column, b: Column) -> Column:
    """Whether two fingerprints are of equal texts: the roots say it."""
    return F.substring(a, 1, 64) == F.substring(b, 1, 64)


def _leaves(f: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(f, F.lit(LEAF), F.lit(0)))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, leaf: n + F.substring_index(leaf, ".", -1).cast("long"))


def _near(same: Column, a: Column, b: Column, weight_a: Column, weight_b: Column) -> Column:
    shared = _weight(F.array_intersect(a, b))
    return F.when(same, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * shared, weight_a + weight_b), F.lit(0.0)))


def likeness(a: Column, b: Column) -> Column:
    """Characters of the leaves that both trees hold, against the mean of both; 1 for equal roots."""
    left, right = _leaves(a), _leaves(b)
    return _near(same_text(a, b), left, right, _weight(left), _weight(right))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Numbers of the paragraphs of ``b`` (from 0) under branches that ``a`` does not hold.

    Sections of ``b`` whose hash stands in ``a`` are passed over whole, then paragraphs.
    """
    sections = lambda f: F.slice(F.split(f, r"\|"), F.lit(2), F.size(F.split(f, r"\|")))
    paragraphs = lambda s: F.split(F.substring_index(s, "=", -1), ";")
    hashes = lambda parts, sign: F.transform(parts, lambda x: F.substring_index(x, sign, 1))
    known_sections = hashes(sections(a), "=")
    known = hashes(F.flatten(F.transform(sections(a), paragraphs)), ":")
    marks = F.flatten(
        F.transform(
            sections(b),
            lambda s: F.when(
                F.array_contains(known_sections, F.substring_index(s, "=", 1)), F.transform(paragraphs(s), lambda p: F.lit(False))
            ).otherwise(F.transform(paragraphs(s), lambda p: ~F.array_contains(known, F.substring_index(p, ":", 1)))),
        )
    )
    numbered = F.transform(marks, lambda m, i: F.when(m, i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _position(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``, by a search in two steps."""
    below = lambda part: F.size(F.filter(part, lambda b: b < value))
    array = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.expr("cast(array() AS array<bigint>)")
    width = max(1, math.isqrt(len(bounds)))
    if width < 8:
        return below(array(bounds))
    tops, parts = bounds[::width], [bounds[i + 1 : i + width] for i in range(0, len(bounds), width)]
    first = below(array(tops))
    inside = below(F.element_at(F.array(*[array(p) for p in parts]), first))
    return F.when(first == 0, 0).otherwise((first - 1) * width + 1 + inside)


def with_next_text(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rows_per_block: int = 4096, most_blocks: int = 1 << 16
) -> DataFrame:
    """(id, text, next_text): the text of the next document in falling id order; after the last comes the first.

    Equal ids follow each other by the digest of their text; null ids come last. The order is cut
    into blocks by quantiles of the id (at most ``most_blocks``, so the bounds stay small; more
    rows make larger blocks, not other results). Each block is one sorted window partition; the
    first row of a block is also sent to the block before it, where it stands last.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = rows.count()
    blocks = max(1, min(most_blocks, -(-count // rows_per_block)))
    shares = [i / blocks for i in range(1, blocks)]
    numbers = rows.select(F.col("id").cast("double").alias("x"))
    cuts = numbers.approxQuantile("x", shares, 0.25 / blocks) if shares else []
    bounds = sorted({int(c) for c in cuts})
    block = F.when(F.col("id").isNull(), 0).otherwise(_position(F.col("id"), bounds) + 1).cast("int")
    heads = rows.select(block.alias("block"), "id").groupBy("block").agg(F.max("id").alias("head")).collect()  # a row a block
    heads = sorted((r.block, r.head) for r in heads)
    before = {b: heads[(k + 1) % len(heads)][0] for k, (b, _) in enumerate(heads)}
    top = max(before, default=0)
    first = F.array(*[F.lit(dict(heads).get(b)).cast("long") for b in range(top + 1)])
    goes = F.array(*[F.lit(before.get(b)).cast("int") for b in range(top + 1)])
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(goes, F.col("block")).alias("block"), F.lit(True).alias("guest"))
    is_head = F.col("id").eqNullSafe(F.get(first, F.col("block")))
    placed = (
        rows.withColumn("block", block)
        .withColumn("to", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
        .select("id", "text", "to.block", "to.guest")
    )
    order = Window.partitionBy("block").orderBy("guest", F.col("id").desc_nulls_last(), F.sha2(F.col("text").cast("binary"), 256))
    return placed.withColumn("next_text", F.lead("text").over(order)).where("not guest").select("id", "text", "next_text")


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text", **blocks: int) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text ends with the first floor(n_chars / 3) code points of the next document (or all
    it has) instead of the text's own. Null texts count as empty; an empty text is equal to its
    edited text. Ties, null ids and the order are those of ``with_next_text``. An empty table gives
    an empty table; other columns are not looked at.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) AS int))"), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_next_text(docs, id, text, **blocks).select("id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = rows.select(
        "id",
        "n_chars",
        _sha(F.col("edited")).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    # the leaves of each tree are taken from it once, since both figures need those of the text
    trees = {"own": "fingerprint", "edited": "edited_fingerprint", "next": "next_fingerprint"}
    rows = rows.withColumns({f"{k}_leaves": _leaves(F.col(c)) for k, c in trees.items()})
    rows = rows.withColumns({f"{k}_weight": _weight(F.col(f"{k}_leaves")) for k in trees})

    def near(other: str) -> Column:
        same = same_text(F.col("fingerprint"), F.col(trees[other]))
        return _near(same, F.col("own_leaves"), F.col(f"{other}_leaves"), F.col("own_weight"), F.col(f"{other}_weight"))

    return rows.select(
        F.col("id").alias(id),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
    )
