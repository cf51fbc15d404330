"""Near duplicates by the Jaccard likeness of word shingles: T-occurrence search with DivideSkip."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import blocks
from chalkline.llm.components import components
from chalkline.llm.repeats import _by, _pack40, _unpack40
from chalkline.llm.words import Words, column_bytes, mix, slices
from chalkline.session import cut_lineage

NULL_ID = 2**63 - 1
#: a set weighs as much as its shingles and this
GROUP = 256
#: nodes that may link, directly or not, are searched as one group up to this weight in all, else in blocks of half of it
WHOLE = 4_000_000
#: of up to this many sets under a key each pair is looked at, of more the pairs with the first
SHORT = 8
#: bits of a sketch, at most
SKETCH = 1 << 13
#: central sets that are tried against all others of a group before the search
PIVOTS = 8
#: sets with too many empty parts are dealt again this often before they meet under single tokens: first without their
#: common tokens, then whole
RARE_DEALS, DEALS = 4, 8
#: tokens that count as common, at most; which ones they are changes how many unlike sets meet, never the result
COMMON = 1 << 18
#: a token is counted where it is in this many of the sets of about ``CHUNK`` tokens that are read together
OFTEN, CHUNK = 8, 1 << 21
#: bytes of text whose words and shingles are held at a time
SLICE = 1 << 19


# ---------------------------------------------------------------- sets


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its different shingles of ``k`` lower-cased words.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    w = Words(column, lower=True)
    h = w.hashes()
    at, g = w.grams(h, k)
    row = w.row[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        start = w.first[:-1][short]
        row = np.concatenate([row, short])
        g = np.concatenate([g, w.runs(h, start, start + count[short])])
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    row, g = row[new], g[new]
    return np.split(g, np.searchsorted(row, np.arange(1, len(column))))


def node_of(tokens: np.ndarray) -> int:
    """64 bits of a digest of the set: equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


class Levels:
    """Size classes and the number of parts into which a set of a level is dealt.

    Sets a and b link if den |a n b| >= num |a u b|, so they differ in at most
    d = (|a| + |b|) (den - num) / (den + num) tokens. Bands of sizes are so wide that sets which
    link lie in the same or in adjacent bands; level v holds the pairs whose larger set is in band
    v. If the tokens are dealt to more than d parts by a hash, one part at least is the same in
    both. If more parts of a set hold tokens than can differ, one of the equal ones is not empty. A
    set without so many is bare. Two sets whose equal parts are all empty are both bare, so bare
    sets are dealt again by another hash, and those that are bare in all deals meet under their first
    tokens, ``common`` ones last and then by hash: of n tokens any n - ceil(n num / den) + 1 hold one that is shared.

    What holds for the sets holds for what is left of them without the ``common`` tokens, since these differ in
    no more tokens. So the first deals leave them out: unlike sets that share a passage with many others would
    meet under parts that hold nothing else. Only sets that are bare without them are dealt whole.
    """

    def __init__(self, num: int, den: int, common: np.ndarray | None = None):
        if not 0 < num <= den:
            raise ValueError("the likeness must be above 0 and at most 1")
        self.num, self.den = num, den
        self.common = np.zeros(0, np.uint64) if common is None else common
        self.top: list[int] = []  # largest size of each band
        self.grow(1)

    def is_common(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(tokens), bool)
        return self.common[np.minimum(np.searchsorted(self.common, tokens), len(self.common) - 1)] == tokens

    def grow(self, size: int) -> None:
        while not self.top or self.top[-1] < size:
            low = self.top[-1] + 1 if self.top else 1
            self.top.append(low * self.den // self.num)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(self.top, sizes)

    def differ(self, level: np.ndarray) -> np.ndarray:
        while len(self.top) <= level.max(initial=0):
            self.grow(self.top[-1] + 1)
        return 2 * np.array(self.top, np.int64)[level] * (self.den - self.num) // (self.den + self.num)

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the set, key) under which sets that may link meet."""
        sizes = np.array([len(s) for s in sets], np.int64)
        band = self.band(sizes)
        out_set, out_key = [], []
        rare = [s[~self.is_common(s)] for s in sets]
        rare_sizes = np.array([len(s) for s in rare], np.int64)
        for step in (0, 1):
            level = band + step
            d, top = self.differ(level), np.array(self.top, np.int64)[level]
            # a set that may link has at most sizes * den / num tokens, and at most those of the level
            apart = np.minimum(d, (sizes + np.minimum(top, sizes * self.den // self.num)) * (self.den - self.num) // (self.den + self.num))
            parts = d + 1 + -(-d // 16)
            salt = level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            left = np.flatnonzero(sizes > 0)
            for deal in range(RARE_DEALS + DEALS):
                if not len(left):
                    break
                held, held_sizes = (rare, rare_sizes) if deal < RARE_DEALS else (sets, sizes)
                tokens, owner = np.concatenate([held[i] for i in left.tolist()]), np.repeat(left, held_sizes[left])
                if not len(tokens):
                    continue
                spread = mix(tokens ^ np.uint64(0x51ED270B))
                by = tokens if deal == 0 else mix(tokens + np.uint64(deal * 0xA0761D6478BD642F % 2**64))
                base = np.cumsum(parts) - parts
                place = base[owner] + ((by >> np.uint64(20)) % parts[owner].astype(np.uint64)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place = place[order]
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                total = np.add.reduceat(spread[order], first)
                who = owner[order][first]
                part = (place[first] - base[who]).astype(np.uint64) + np.uint64(deal << 32)
                out_set.append(who)
                out_key.append(mix(total + salt[who] + part * np.uint64(0xD1B54A32D192ED03)))
                full = np.bincount(who, minlength=len(sets))
                left = left[full[left] <= apart[left]]
            for i in left.tolist():
                n = len(sets[i])
                order = np.lexsort((mix(sets[i] ^ np.uint64(0x2545F491)), self.is_common(sets[i])))
                prefix = mix(sets[i] ^ np.uint64(0x2545F491))[order][: n - -(-n * self.num // self.den) + 1]
                out_set.append(np.full(len(prefix), i))
                out_key.append(mix(prefix + salt[i]))
        if not out_set:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(out_set), np.concatenate(out_key)


# ---------------------------------------------------------------- sketches


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all sketches, bytes of each) of sets that lie one after the other.

    A bit is the parity of the tokens that a hash deals to it, so two sketches of one width differ in no more bits than
    the sets in tokens. A wide sketch folds by exclusive or into one of half the width.
    """
    bits = np.minimum(64 << np.ceil(np.log2(np.maximum(sizes, 32) / 32)).astype(np.int64), SKETCH)
    base = np.cumsum(bits) - bits
    place = (mix(tokens ^ np.uint64(0x7F4A7C15)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place + np.repeat(base, sizes), minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(bool), bitorder="little"), bits // 8


def fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each, in the width of so many words."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the rows of two tables of sketches differ, in the smaller width of both."""
    words = min(x.shape[1], y.shape[1])
    return np.bitwise_count(fold(x, words) ^ fold(y, words)).sum(1, dtype=np.int64)


def may_link(differ: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of ``both`` tokens together may link if they differ in ``differ`` tokens or more."""
    return differ * (num + den) <= both * (den - num)


# ---------------------------------------------------------------- search in a group


class Group:
    """Sets, their inverted lists, and which of them are known to be connected.

    With ``side`` only sets of different sides are tried against each other.
    """

    def __init__(self, sets: list[np.ndarray], known: list[int], num: int, den: int, side: list[int] | None = None):
        size = np.array([len(s) for s in sets], np.int64)
        self.given = np.argsort(size, kind="stable")  # from here on sets go by size
        self.size = size[self.given]
        self.sets, self.num, self.den = [sets[i] for i in self.given.tolist()], num, den
        self.side = None if side is None else np.array(side, np.int8)[self.given]
        self.label = np.unique(np.array(known, np.int64)[self.given], return_inverse=True)[1].ravel()
        self.links: list[tuple[int, int]] = []
        self.wide: list[tuple[int, int, dict[int, np.ndarray]]] | None = None

    def join(self, q: int, found: np.ndarray) -> None:
        """Set ``q`` links with the sets ``found``: one link for each component that is new to it."""
        labels, first = np.unique(self.label[found], return_index=True)
        new = labels != self.label[q]
        for i in found[first[new]].tolist():
            self.links.append((int(self.given[q]), int(self.given[i])))
        if new.any():
            gone = np.zeros(len(self.label), bool)
            gone[labels] = True
            self.label[gone[self.label]] = self.label[q]

    def alike(self, common: np.ndarray, q: int, other: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.den * common >= self.num * (self.size[q] + self.size[other] - common)

    def index(self) -> None:
        """Lists of the sets that hold a token, of the tokens that more than one set holds."""
        tokens = np.concatenate(self.sets)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        new = np.r_[True, tokens[1:] != tokens[:-1], True]
        shared = ~(new[:-1] & new[1:])
        tokens, order = tokens[shared], order[shared]
        self.members = np.repeat(np.arange(len(self.sets), dtype=np.int32), self.size)[order]
        self.start = np.flatnonzero(new[:-1][shared])
        self.token = tokens[self.start]
        self.length = np.diff(np.r_[self.start, len(tokens)])

    def lists(self, q: int) -> np.ndarray:
        """The lists that hold set ``q`` and another."""
        if not len(self.token):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.token, self.sets[q]), len(self.token) - 1)
        return at[self.token[at] == self.sets[q]]

    def merged(self, lists: np.ndarray) -> np.ndarray:
        """In how many of the lists each set is."""
        k = self.length[lists]
        place = np.repeat(self.start[lists] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return np.bincount(self.members[place], minlength=len(self.sets))

    def near(self, q: int) -> np.ndarray:
        """Sets of other components whose size and sketch leave a link with set ``q`` possible."""
        if self.wide is None:
            data, width = sketches(np.concatenate(self.sets), self.size)
            cuts = np.flatnonzero(np.r_[True, width[1:] != width[:-1], True])
            at = np.r_[0, np.cumsum(width)]
            table = lambda a, b: data[at[a] : at[b]].view(np.uint64).reshape(b - a, -1)
            self.wide = [(a, b, {int(width[a]) // 8: table(a, b)}) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        n = int(self.size[q])
        low = int(np.searchsorted(self.size, -(-n * self.num // self.den)))
        high = int(np.searchsorted(self.size, n * self.den // self.num, "right"))
        own = next(table[max(table)][q - a : q - a + 1] for a, b, table in self.wide if a <= q < b)
        out = []
        for a, b, table in self.wide:
            lo, hi = max(a, low), min(b, high)
            if lo >= hi:
                continue
            words = min(own.shape[1], max(table))
            if words not in table:
                table[words] = fold(table[max(table)], words)
            other = self.label[lo:hi] != self.label[q]
            if self.side is not None:
                other &= self.side[lo:hi] != self.side[q]
            c = np.flatnonzero(other)
            rows = table[words][lo - a : hi - a]
            differ = apart(rows if 2 * len(c) > hi - lo else rows[c], own)
            differ = differ[c] if 2 * len(c) > hi - lo else differ
            out.append(lo + c[may_link(differ, n + self.size[lo + c], self.num, self.den)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, q: int) -> None:
        """DivideSkip: the sets that share at least T tokens with set ``q``, where T is the least overlap a link needs.

        A set that shares T tokens is in T of the lists. The longest L of them are put aside, so it is in
        T - L of the short ones: those are merged, and only what occurs often enough and lies near
        is looked for in the long lists, by bisection.
        """
        c = self.near(q)
        if not len(c):
            return
        at = self.lists(q)
        need = -(-self.num * int(self.size[q]) // self.den)
        if len(at) < need:
            return
        aside = min(need - 1, int(need / (0.0085 * math.log2(int(self.length[at].max())) + 1)))
        at = at[np.argsort(-self.length[at], kind="stable")]
        common = self.merged(at[aside:])[c]
        often = common >= need - aside
        c, common = c[often], common[often]
        least = -(-self.num * (self.size[q] + self.size[c]) // (self.num + self.den))
        long = self.token[np.sort(at[:aside])]
        for i, x in enumerate(c.tolist()):
            if common[i] + aside >= least[i]:
                own = self.sets[x]
                common[i] += int((own[np.minimum(np.searchsorted(own, long), len(own) - 1)] == long).sum())
        linked = c[self.alike(common, q, c)]
        if len(linked):
            self.join(q, linked)

    def connect(self) -> list[tuple[int, int]]:
        """Links that connect all sets of the group which are connected inside it.

        A few central sets, whose tokens are the most common, are tried against all others first;
        that settles groups of copies around an original. Then every set outside the largest
        component searches the index; pairs inside a component need none.
        """
        n = len(self.sets)
        self.index()
        weight = np.bincount(self.members, np.repeat(self.length, self.length), n) / self.size
        tried: list[int] = []
        for q in np.argsort(-weight, kind="stable").tolist():
            if len(tried) == PIVOTS:
                break
            if tried and self.label[q] in self.label[tried]:
                continue
            tried.append(q)
            linked = self.alike(self.merged(self.lists(q)), q)
            linked[q] = False
            if self.side is not None:
                linked &= self.side != self.side[q]
            if linked.any():
                self.join(q, np.flatnonzero(linked))
        largest = int(np.flatnonzero(self.label == np.bincount(self.label).argmax())[0])
        for q in range(n):
            if self.label[q] != self.label[largest]:
                self.search(q)
        return self.links


# ---------------------------------------------------------------- Spark


def _ids(batches, limit: int = SLICE):
    for batch in batches:
        for part in slices(batch, "text", limit):
            yield part.column("id").to_numpy().astype(np.int64), part.column("text")


_POSTINGS = "shard int, block int, keys binary, nodes binary"
_NEED = pa.schema([("block", pa.int32()), ("rows", pa.int64())])


def _search_groups(rows: DataFrame, reps: DataFrame, wanted: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found in the groups of ``wanted`` (grp, node, known, side); with sides only between these.

    ``reps`` says which row stands for a node: (node, block, id). Each split gets the list of the
    sets it has to send in a file of its own, reads its texts again and sends those sets.
    """
    spark = rows.sparkSession
    folder, count = blocks.shared_folder(spark, "similar"), blocks.shards(spark)

    def keep(batches):
        need: dict[int, list] = {}
        for b in batches:
            columns = [b.column(c).to_numpy() for c in ("block", "id", "node", "grp", "known", "side")]
            for block, at in _by(columns[0].astype(np.int64), np.arange(b.num_rows)):
                need.setdefault(block, []).append([c[at] for c in columns[1:]])
        out = []
        for block, parts in need.items():
            i, node, grp, known, side = (np.concatenate([p[j] for p in parts]) for j in range(5))
            order = np.lexsort((grp, node))
            blocks.save(folder, f"need-{block}", id=i[order], node=node[order], grp=grp[order], known=known[order], side=side[order])
            out.append((block, len(order)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NEED.types)], schema=_NEED)
        blocks.release()

    needed = wanted.join(reps, "node").repartition(count, "block")
    asked = needed.mapInArrow(keep, "block int, rows long").agg(F.sum("rows")).first()[0] or 0

    def send(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        side = blocks.load(folder, f"need-{block}")
        if not side:
            return
        wanted_ids, left = np.unique(side["id"]), set(side["node"].tolist())
        for ids, texts in _ids(batches):
            chosen = np.flatnonzero(np.isin(ids, wanted_ids))
            if not len(chosen):
                continue
            grp, node, known, sides, data = [], [], [], [], []
            for s in shingle_sets(texts.take(pa.array(chosen)), k):
                x = node_of(s)
                if x in left:
                    left.remove(x)
                    lo, hi = np.searchsorted(side["node"], x), np.searchsorted(side["node"], x, "right")
                    grp += side["grp"][lo:hi].tolist()
                    known += side["known"][lo:hi].tolist()
                    sides += side["side"][lo:hi].tolist()
                    node += [x] * int(hi - lo)
                    data += [s.tobytes()] * int(hi - lo)
            if grp:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grp, pa.int64()), pa.array(node, pa.int64()), pa.array(known, pa.int64()), pa.array(sides, pa.int32()), pa.array(data, pa.binary())],
                    names=["grp", "node", "known", "side", "tokens"],
                )
        if left:
            raise RuntimeError("a split holds other rows than before; store the table first")
        blocks.release()

    def search(batches):
        def groups():
            held: list = []
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("grp", "node", "known", "side", "tokens"))):
                    if held and held[0][0] != row[0]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        a, b = [], []
        for g in groups():
            if len(g) > 1:
                sets = [np.frombuffer(r[4], np.uint64) for r in g]
                side = [r[3] for r in g] if g[0][3] >= 0 else None
                for i, j in Group(sets, [r[2] for r in g], num, den, side).connect():
                    a.append(g[i][1])
                    b.append(g[j][1])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        blocks.release()

    if not asked:
        return spark.createDataFrame([], "a long, b long")
    sent = rows.mapInArrow(send, "grp long, node long, known long, side int, tokens binary")
    return cut_lineage(sent.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(search, "a long, b long"))


def _blocks(large: DataFrame) -> DataFrame:
    """(grp, node, n, blk) of (grp, node, n): blocks of a part by size, of about half of ``WHOLE`` in weight."""
    weight = F.col("n") + GROUP
    sizes = large.groupBy("grp", "n").agg(F.sum(weight).alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("grp").orderBy("n")) - F.col("weight")
    sizes = sizes.select("grp", "n", "weight", before.alias("before"))
    # sets of one size lie spread over the weight of that size
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = F.col("before") + spread * F.col("weight")
    return large.join(sizes, ["grp", "n"]).select("grp", "node", "n", F.floor(place / (WHOLE / 2)).cast("long").alias("blk"))


def _across(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, node, side) of each two blocks of a part that hold sets whose sizes allow a link."""
    ends = dealt.groupBy("grp", "blk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = ends.select("grp", F.col("blk").alias("blk2"), F.col("low").alias("low2"))
    two = ends.join(other, "grp").where((F.col("blk") < F.col("blk2")) & (den * F.col("high") >= num * F.col("low2")))
    two = two.select("grp", F.xxhash64("grp", "blk", "blk2").alias("to"), F.array("blk", "blk2").alias("both"))
    two = two.select("grp", "to", F.posexplode("both").alias("side", "blk"))
    return dealt.join(two, ["grp", "blk"]).select(F.col("to").alias("grp"), "node", "side")


def _meeting(rows: pa.RecordBatch, num: int, den: int) -> np.ndarray:
    """Which pairs of sets (n, sketch, n2, sketch2) may link."""
    n, n2 = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "n2"))
    (x, at), (y, at2) = (column_bytes(rows.column(c)) for c in ("sketch", "sketch2"))
    width, width2 = np.diff(at), np.diff(at2)
    keep = np.zeros(rows.num_rows, bool)
    for w, where in _by(width << 16 | width2, np.arange(rows.num_rows)):
        table = lambda data, start, k: data[start[where][:, None] + np.arange(k)].view(np.uint64)
        keep[where] = may_link(apart(table(x, at, w >> 16), table(y, at2, w & 0xFFFF)), n[where] + n2[where], num, den)
    return keep & (den * np.minimum(n, n2) >= num * np.maximum(n, n2))


def _connected(docs: DataFrame, id: str, text: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, node, block, row_key) of every row, and (node, least, root) of every set: see ``similar_documents``."""
    spark = docs.sparkSession
    count, folder = blocks.shards(spark), blocks.shared_folder(spark, "common")
    rows = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        blocks.row_key(id, text).alias("row_key"),
    )

    def describe(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        nodes, held, size = set(), [], 0
        names_of = ["id", "n", "node", "block", "row_key", "sketch", "token", "seen"]

        def often():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n >= OFTEN], n[n >= OFTEN]
            empty = [pa.nulls(len(token), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*empty, pa.array(token.view(np.int64)), pa.array(n)], names=names_of)

        for part in (p for b in batches for p in slices(b, "text", SLICE)):
            ids, sets = part.column("id").to_numpy(), shingle_sets(part.column("text"), words)
            names = [node_of(s) if len(s) else None for s in sets]
            for s, x in zip(sets, names):  # equal sets count once
                if x is not None and x not in nodes:
                    nodes.add(x)
                    held.append(s)
                    size += len(s)
            if size > CHUNK:
                yield often()
                nodes, held, size = set(), [], 0
            full = [s for s in sets if len(s)]
            data, width = sketches(np.concatenate(full), np.array([len(s) for s in full])) if full else (np.zeros(0, np.uint8), [])
            drawn = iter(np.split(data, np.cumsum(width)[:-1])) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if i == NULL_ID else i for i in ids.tolist()], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(np.full(len(sets), block, np.int32)),
                    part.column("row_key"),
                    pa.array([next(drawn).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.int64()),
                    pa.nulls(len(sets), pa.int64()),
                ],
                names=names_of,
            )
        if held:
            yield often()
        blocks.release()

    read = cut_lineage(rows.mapInArrow(describe, "id long, n long, node long, block int, row_key long, sketch binary, token long, seen long"))
    described = read.where("token IS NULL").drop("token", "seen", "sketch")
    seen = read.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
    frequent = seen.orderBy(F.desc("seen"), "token").limit(COMMON).select("token").toPandas()["token"].to_numpy(np.int64)
    blocks.save(folder, "common", token=np.sort(frequent.view(np.uint64)))
    classes = described.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("least"), F.max("n").alias("n"), F.min(F.struct("block", F.coalesce("id", F.lit(NULL_ID)).alias("id"))).alias("rep")
    )
    reps, sizes = classes.select("node", "rep.block", "rep.id"), classes.select("node", "n")

    def post(batches):
        from pyspark import TaskContext

        block, seen = TaskContext.get().partitionId(), set()
        levels = Levels(num, den, blocks.load(folder, "common")["token"])
        for _, texts in _ids(batches):
            sets = [s for s in shingle_sets(texts, words) if len(s)]
            fresh = []
            for s in sets:
                x = node_of(s)
                if x not in seen:
                    seen.add(x)
                    fresh.append((x, s))
            if not fresh:
                continue
            owner, keys = levels.keys([s for _, s in fresh])
            nodes = np.array([x for x, _ in fresh], np.int64)[owner]
            # a shard is told by other bits than the 40 that are written, so keys are equal in 40 bits and those of the shard
            shard = ((keys & np.uint64(0xFFFFFF)) % np.uint64(count)).astype(np.int64)
            keys = keys >> np.uint64(24)
            order = np.argsort(owner, kind="stable")  # the entries of a node stay together, which packs better
            out = [(s, block, _pack40(keys[at]), nodes[at].astype("<i8").tobytes()) for s, at in _by(shard[order], order)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int32(), pa.binary(), pa.binary()])]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "keys", "nodes"])
        blocks.release()

    def meet(batches):
        keys, nodes = [], []
        for b in batches:
            for k, n in zip(b.column("keys").to_pylist(), b.column("nodes").to_pylist()):
                keys.append(_unpack40(k))
                nodes.append(np.frombuffer(n, "<i8"))
        if not keys:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        del keys, nodes
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        del order
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        length = np.diff(cuts)
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(2, SHORT + 1):
            members = node[cuts[:-1][length == k][:, None] + np.arange(k)]
            # near copies meet under many keys: each list once
            name = np.zeros(len(members), np.uint64)
            for i in range(k):
                name = mix(name + members[:, i].astype(np.uint64))
            members = members[np.argsort(name, kind="stable")]
            members = members[np.r_[True, (members[1:] != members[:-1]).any(1)][: len(members)]]
            pairs += [members[:, [i, j]] for i in range(k) for j in range(i + 1, k)]
        yield from told(np.concatenate(pairs), True)
        long = np.flatnonzero(length > SHORT)
        k = length[long]
        rest = np.repeat(cuts[long] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
        yield from told(np.stack([np.repeat(node[cuts[long]], k), node[rest]], 1), False)
        del key, node, new, members, pairs, rest
        blocks.release()

    def told(pairs, each):
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = pairs[:, 0] != pairs[:, 1]
        new[1:] &= (pairs[1:] != pairs[:-1]).any(1)
        pairs = pairs[new]
        for i in range(0, len(pairs), 1 << 16):
            part = pairs[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), pa.array(np.full(len(part), each))], names=["a", "b", "each"])

    def near(batches):
        for batch in batches:
            keep = pa.array(_meeting(batch, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    posted = blocks.by_shard(rows.mapInArrow(post, _POSTINGS), count)
    met = blocks.cut(posted.mapInArrow(meet, "a long, b long, each boolean"))
    # pairs whose sketches leave a link possible; of a key with many sets all pairs with the first, since others may link
    drawn = read.where("node IS NOT NULL").select("node", "n", "sketch")
    looked = met.where("each").select("a", "b").distinct()
    asked = looked.select(F.col("a").alias("node")).union(looked.select(F.col("b").alias("node"))).distinct()
    drawn = blocks.cut(drawn.join(asked, "node").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch")))
    second = drawn.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    looked = looked.join(drawn.withColumnRenamed("node", "a"), "a").join(second, "b")
    pairs = blocks.cut(looked.mapInArrow(near, "a long, b long").union(met.where("not each").select("a", "b").distinct()))

    # nodes that may link, directly or not: most such parts are small enough to be searched whole
    part = components(pairs).join(sizes, "node")
    weight = part.groupBy("root").agg(F.sum(F.col("n") + GROUP).alias("weight"))
    part = blocks.cut(part.join(weight, "root").select("node", "n", F.col("root").alias("grp"), (F.col("weight") <= WHOLE).alias("small")))
    alone = lambda grp: [grp, "node", F.col("node").alias("known"), F.lit(-1).alias("side")]
    wanted, large = part.where("small").select(*alone("grp")), not part.where("not small").isEmpty()
    if large:  # in blocks first, each for itself
        dealt = blocks.cut(_blocks(part.where("not small").select("grp", "node", "n")))
        wanted = wanted.union(dealt.select(*alone(F.xxhash64("grp", "blk").alias("grp"))))
    links = _search_groups(rows, reps, wanted, words, num, den)
    if large:  # then each two blocks that sizes allow, with what is connected by now
        roots = components(links).select("node", F.col("root").alias("known"))
        wanted = _across(dealt, num, den).join(roots, "node", "left").select("grp", "node", F.coalesce("known", "node").alias("known"), "side")
        links = links.union(_search_groups(rows, reps, wanted, words, num, den))

    roots = components(links)
    named = classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return described, blocks.cut(named)


def similar_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two rows link when den x (common shingles) >= num x (all shingles of both). Rows without words
    have no shingles and link with nothing. Null texts count as empty; a null id is larger than
    any other; repeated rows are rows with the same set. An empty table gives an empty table, other
    columns are not looked at.

    1. Equal sets become one node, however many rows have them. The up to ``COMMON`` shingles found most often are common.
    2. Nodes that may link meet under a key of an equal part (see ``Levels``); this loses no link.
    3. Of up to ``SHORT`` nodes under a key each pair is held against a bound on their differences from their sketches
       (see ``sketches``), which drops unlike sets and loses no link; of more each is paired with the first.
    4. Nodes that are paired, directly or through others, are a part. A part of up to ``WHOLE`` in weight
       is searched as one group (see ``Group``). A larger one is cut into blocks by size; each block is searched, then
       each two blocks whose sizes allow a link, so a set is sent as often as its part has blocks, however many keys it has.
    5. Components are found by contraction; a row takes the smallest id of its component.

    Sets travel for nodes that may link with others only; texts never do (see ``blocks``, which also says
    what ``docs`` must be). Sets are told apart by 64 bits.
    """
    described, named = _connected(docs, id, text, words, num, den)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "root").select("node", "component_id")
    return described.join(of_node, "node", "left").select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_dissimilar(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (null last). Rows without words stay."""
    described, named = _connected(docs, id, text, words, num, den)
    row = F.struct(F.col("id").isNull().alias("last"), "id", "node", "block", "row_key")
    first = described.where("node IS NOT NULL").groupBy("node").agg(F.min(row).alias("row"))
    chosen = first.join(named.select("node", "root"), "node").groupBy("root").agg(F.min("row").alias("row")).select("row.block", "row.row_key")
    bare = described.where("node IS NULL").select("block", "row_key")
    return blocks.repeat_rows(docs, chosen.union(bare).withColumn("copies", F.lit(1)), id, text)
