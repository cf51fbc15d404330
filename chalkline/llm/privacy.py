"""Personal data: fixed patterns give seeds, their contexts become patterns that find further identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.session import cut_lineage

# fixed values: what a seed looks like, in the order of the kinds. Written so that a failed start is
# not tried again inside the same run of characters, and without nested backtracking: the matches
# are those of the plain patterns, in linear time and constant stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: what may be an identifier though no seed pattern knows it: a run of these characters with a digit or an @ in it
TOKEN = r"(?<![0-9A-Za-z@._%+/()#-])[A-Za-z._%+/()#-]*+[0-9@](?:[0-9A-Za-z@._%+/()#-]*[0-9A-Za-z)])?"
#: up to so many of them, one space apart, may be one identifier; it has at least and at most so many characters
RUN, SHORT, LONG = 4, 4, 64
#: secrets are no kind of the digest: key ids, and what is assigned to a name that says so
SECRET = len(KINDS)
LABEL = r"(?:password|passwd|secret|token|api_key|apikey|access_key)[\"']{0,1}[\x20]{0,2}[=:][\x20]{0,2}[\"']{0,1}"
SECRETS = rf"(?<![0-9A-Za-z])AKIA[0-9A-Z]{{16}}(?![0-9A-Za-z])|(?i)(?<={LABEL})[^\x20\x09-\x0D\"']{{8,}}+"

def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def _valid(kind: str):
    if kind == "ip":
        return lambda hit: hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return lambda hit: _digits(hit).between(13, 19) & F.call_function("luhn_check", F.regexp_replace(hit, "[^0-9]", ""))
    if kind == "phone":
        return lambda hit: _digits(hit).between(9, 15)
    return lambda hit: F.lit(True)


#: hits are placed in blocks of so many, and contexts read from chunks of so many code points, so that neither reads the whole text for each hit
BLOCK, CHUNK = 256, 128
NO_MATCH = "cast(array() AS array<struct<s:int,e:int,hit:string>>)"


def matches(text: Column, pattern: str, valid) -> Column:
    """array of (s, e, hit): all leftmost non-overlapping matches that are valid, in code points.

    What lies between the matches comes from ``split``, the matches from ``regexp_extract_all``;
    the place of a match is the sum of the lengths before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    none = F.expr(NO_MATCH)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["hit"])
        found = F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit")))
        return F.struct(e.alias("at"), F.when(valid(x["hit"]), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def block(all: Column, k: Column) -> Column:
        return F.aggregate(F.slice(all, k * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shift(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["hit"].alias("hit")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def whole(all: Column) -> Column:
        # places within blocks of hits first, then the blocks one after another: appending is never to a long array
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all) - 1) / BLOCK).cast("int")), lambda k: block(all, k))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS array<{NO_MATCH[16:-1]}>)").alias("out"))
        return F.when(F.size(all) > 0, F.flatten(F.aggregate(parts, start, shift, lambda acc: acc["out"]))).otherwise(none)

    return F.get(F.transform(F.array(pairs), whole), F.lit(0))


def _near(chunks: Column, start: Column, size: Column) -> Column:
    """``size`` <= CHUNK code points of a text from ``start`` on, from two of its chunks instead of the whole text."""
    k = F.floor(start / CHUNK).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit("")))
    return F.substring(two, start - k * CHUNK + 1, size)


def _word(c: Column) -> Column:
    """A context word without case, outer punctuation and particular digits."""
    bare = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}=:]+$", "")
    return F.regexp_replace(bare, "[0-9]", "0")


def _contexts(chunks: Column, span: Column, width: int) -> Column:
    """The lexical patterns a span stands in: the word before, two words before, words on both sides, a label it is joined to."""
    start = F.greatest(span["s"] - width, F.lit(0))
    left = F.split(_near(chunks, start, span["s"] - start), r"[\x20\x09-\x0D]+", -1)
    right = F.split(_near(chunks, span["e"], F.lit(width)), r"[\x20\x09-\x0D]+", -1)
    joined, l1, l2 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(left, F.lit(-3))
    r1 = F.try_element_at(right, F.lit(2))
    l1, l2, r1, joined = (F.coalesce(_word(x), F.lit("")) for x in (l1, l2, r1, joined))
    return F.array_distinct(
        F.filter(
            F.array(
                F.when(l1 != "", F.concat(F.lit("1 "), l1)),
                F.when((l1 != "") & (l2 != ""), F.concat(F.lit("2 "), l2, F.lit(" "), l1)),
                F.when((l1 != "") & (r1 != ""), F.concat(F.lit("b "), l1, F.lit(" _ "), r1)),
                F.when(joined.rlike("[=:]$"), F.concat(F.lit("j "), joined)),
            ),
            lambda p: p.isNotNull(),
        )
    )


def _of_kind(spans, kind: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["hit"].alias("hit")))


def _shape(value: Column) -> Column:
    """The pattern of a value itself: each digit as 0, each run of letters as one a."""
    return F.concat(F.lit("s "), F.regexp_replace(F.regexp_replace(F.lower(value), "[a-z]+", "a"), "[0-9]", "0"))


def _runs(chunks: Column, tokens: Column) -> tuple[Column, Column]:
    """The tokens with the mark of those one space before the next (column __ends), and every run of up to RUN of
    them as (kind null, s, e, hit, whole).

    ``whole`` is false for a run that could go on: the longest one from its start stands for that place.
    """
    glued = F.transform(tokens, lambda x, i: F.coalesce((F.get(tokens, i + 1)["s"] == x["e"] + 1) & (_near(chunks, x["e"], F.lit(1)) == " "), F.lit(False)))
    ends = F.transform(
        F.arrays_zip(F.transform(tokens, lambda x: x["s"]).alias("s"), F.transform(tokens, lambda x: x["e"]).alias("e"), F.transform(tokens, lambda x: x["hit"]).alias("hit"), glued.alias("g")),
        lambda x: x,
    )

    def from_place(x: Column, i: Column) -> Column:
        out, hit, on = [], x["hit"], F.lit(True)
        for k in range(RUN):
            last = F.get("__ends", i + k)
            if k:
                hit = F.concat(hit, F.lit(" "), last["hit"])
            more = last["g"] if k + 1 < RUN else F.lit(False)
            fits = F.length(hit).between(SHORT, LONG) & hit.rlike("[0-9@]")
            out.append(F.when(on & fits, F.struct(F.lit(None).cast("int").alias("kind"), x["s"].alias("s"), last["e"].alias("e"), hit.alias("hit"), (~more).alias("whole"))))
            on = on & more
        return F.array_compact(F.array(*out))

    return ends, F.flatten(F.transform("__ends", from_place))


def find_seeds(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 48) -> DataFrame:
    """id and ``found``: array of (kind, s, e, value, whole, contexts). Null texts count as empty.

    Kinds 0 to 3 are the base matches, 4 is a secret; null marks a candidate (see ``TOKEN`` and ``_runs``) outside them.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), whole.alias("text"))
    rows = rows.withColumns({"at": F.contains("text", F.lit("@")), "digit": F.col("text").rlike("[0-9]"), "label": F.col("text").rlike(f"(?i){LABEL}|AKIA")})
    empty = F.expr(NO_MATCH)
    needs = {"email": F.col("at"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("digit")}
    found = {k: F.when(needs[k], matches(F.col("text"), PATTERNS[k], _valid(k))).otherwise(empty) for k in KINDS}
    found["secret"] = F.when(F.col("label"), matches(F.col("text"), SECRETS, _valid("secret"))).otherwise(empty)
    found["token"] = F.when(F.col("digit") | F.col("at"), matches(F.col("text"), TOKEN, _valid("token"))).otherwise(empty)
    found["chunks"] = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    rows = rows.withColumns(found)
    rows = rows.withColumn("seeds", F.concat(*[_of_kind(k, F.lit(i)) for i, k in enumerate([*KINDS, "secret"])]))
    rows = rows.withColumn("free", F.filter("token", lambda x: ~F.exists("seeds", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    ends, runs = _runs(F.col("chunks"), F.col("free"))
    rows = rows.withColumn("__ends", ends).withColumn("runs", runs)
    sure = F.transform("seeds", lambda x: x.withField("whole", F.lit(True)))
    spans = F.transform(
        F.concat(sure, F.col("runs")),
        lambda x: F.struct(
            x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["hit"]).alias("value"), x["whole"].alias("whole"),
            F.concat(_contexts(F.col("chunks"), x, width), F.array(_shape(x["hit"]))).alias("contexts"),
        ),
    )
    some = F.col("at") | F.col("digit") | F.col("label")
    return rows.select("id", F.when(some, spans).otherwise(F.slice(spans, F.lit(1), F.lit(0))).alias("found"))


def bootstrap(spans: DataFrame, rounds: int = 3, support: int = 4, confident: float = 0.8) -> DataFrame:
    """(value, kind, shaped) of identifiers without a seed pattern that confident patterns vouch for, a shape among them or not.

    ``spans``: value, kind (null if no seed), whole, contexts. The graph has an edge for each value and
    pattern (context or shape) that occur together. A seed is certain of its kind. In each round the
    score of a pattern for a kind is the summed confidence of its different values, divided by the number
    of all different values it introduces, plus one; it is confident from ``confident`` on, if at least
    ``support`` different seeds or values learnt before stand in it. A value without seed is as certain as
    its best confident pattern. All values of a pattern count against it, so one that also introduces
    other things never gets far; of the runs that begin in one place a context counts the longest alone.
    """
    edges = spans.select("value", "kind", "whole", F.explode("contexts").alias("context"))
    edges = cut_lineage(edges.groupBy("value", "context").agg(F.max("kind").alias("kind"), F.max("whole").alias("whole")))
    sizes = edges.where(F.col("whole") | F.startswith("context", F.lit("s "))).groupBy("context").agg(F.count("*").alias("n"))
    known = edges.where("kind IS NOT NULL").select("context", "value", "kind", F.lit(1.0).alias("conf"))
    unseen = edges.where("kind IS NULL").select("value", "context")
    learnt = None
    for _ in range(rounds):
        facts = known if learnt is None else known.unionByName(
            unseen.join(learnt, "value").select("context", "value", "kind", "conf")
        )
        scores = (
            facts.groupBy("context", "kind")
            .agg(F.sum("conf").alias("mass"), F.count("*").alias("values"))
            .where(F.col("values") >= support)
            .join(sizes, "context")
            .withColumn("score", F.col("mass") / (F.greatest("n", "values") + 1))
            .where(F.col("score") >= confident)
        )
        votes = unseen.join(scores.select("context", "kind", "score"), "context")
        best = votes.groupBy("value").agg(
            F.max(F.struct("score", -F.col("kind"))).alias("b"), F.max(F.startswith("context", F.lit("s "))).alias("shaped")
        )
        # the second field is the kind with its sign turned: of equal scores the first kind wins
        learnt = cut_lineage(best.select("value", (-F.col("b")["col2"]).alias("kind"), F.col("b")["score"].alias("conf"), "shaped"))
    return learnt.select("value", "kind", "shaped")


def _leftmost(spans) -> Column:
    """Of spans by start, the longest first, those that do not begin inside the one kept before."""
    none = F.expr("cast(array() AS array<struct<s:int,back:int,kind:int>>)")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["kind"].alias("kind"))))
    kept = F.aggregate(
        ordered, none, lambda acc, x: F.when(F.coalesce(-F.try_element_at(acc, F.lit(-1))["back"], F.lit(0)) <= x["s"], F.concat(acc, F.array(x))).otherwise(acc)
    )
    return F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), (-x["back"]).alias("e")))


def _apart(rows: DataFrame, spans: str) -> DataFrame:
    """Spans that do not overlap: those whose own shape is known first, then the others where there is room."""
    rows = rows.withColumn("__sure", _leftmost(F.filter(spans, lambda x: x["shaped"])))
    free = F.filter(spans, lambda x: ~x["shaped"] & ~F.exists("__sure", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return rows.withColumn(spans, F.concat("__sure", _leftmost(free))).drop("__sure")


def find_private(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 4, confident: float = 0.8
) -> DataFrame:
    """One row per row of ``docs``: id, and ``base``, ``added`` and ``secrets``, arrays of (kind, s, e) in code points.

    ``base`` holds what the fixed patterns match. ``added`` is what bootstrapping found beside it: a run of one to
    RUN tokens with a digit or an @ that the learnt values name; where several overlap, those of a known
    shape come first, then the leftmost and longest. A run of fewer than SHORT or more than LONG characters is no identifier. ``secrets`` are the
    passwords and keys of kind SECRET, seeds and learnt ones.
    Null texts count as empty, repeated and null ids keep their rows, an empty table gives an empty
    table, other columns are not looked at.
    """
    found = cut_lineage(find_seeds(docs, id, text)).withColumn("row", F.monotonically_increasing_id())
    spans = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    learnt = bootstrap(spans, rounds, support, confident)
    added = (
        spans.where("kind IS NULL")
        .select("row", "value", "s", "e")
        .join(learnt, "value")
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "s", "e", "shaped")).alias("more"))
    )
    added = _apart(added, "more")

    def part(kept) -> Column:
        return F.transform(
            F.array_sort(F.filter("found", kept)), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
        )

    none = F.expr("cast(array() AS array<struct<kind:int,s:int,e:int>>)")
    rows = found.select("row", "id", part(lambda x: x["kind"] < SECRET).alias("base"), part(lambda x: x["kind"] == SECRET).alias("secrets"))
    rows = rows.join(added, "row", "left").withColumn("more", F.coalesce("more", none))
    learnt_secrets = F.filter("more", lambda x: x["kind"] == SECRET)
    return rows.select(
        F.col("id").alias(id), "base", F.array_sort(F.filter("more", lambda x: x["kind"] < SECRET)).alias("added"),
        F.array_sort(F.concat("secrets", learnt_secrets)).alias("secrets"),
    )


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of their list, the list of all spans, and the counts of added spans and secrets."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans) -> Column:
        one = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string")))
        return F.array_join(one, ",")

    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, F.lit(i).eqNullSafe)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        F.col(id),
        *counts,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size("secrets").cast("long").alias("n_secret"),
        (F.size("base") + F.size("added") + F.size("secrets")).cast("long").alias("n_private"),
    )
