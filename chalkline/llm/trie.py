"""Prefix trie of conversations: sorted matrices of turn ids, node starts where a column changes, boundary nodes refolded."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import blocks
from chalkline.llm.words import WORD
from chalkline.session import cut_lineage

#: bytes of one turn: 16 of its SHA-256 and its number of words, so that byte order is the order of the ids
TURN = 20
#: columns of a padded matrix that are sorted at a time
TILE = 16
#: bytes of turns aimed at for one shard
SHARD = 8 << 20
_NOBODY = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_OUT = (
    "kind string, shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends string, key binary, parent_key binary, data binary, parts binary"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_FIELDS = [(name, _ARROW[kind]) for name, kind in (c.split() for c in _OUT.split(", "))]


def _rows(kind: str, shard: int, count: int, **columns) -> pa.RecordBatch:
    columns = {"kind": [kind] * count, "shard": [shard] * count} | columns
    arrays = [pa.array(columns[n], t) if n in columns else pa.nulls(count, t) for n, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _FIELDS])


def first_turns(conv: Column) -> Column:
    """How many turns a conversation takes over: the unsigned CRC-32 of its decimal id, modulo 4."""
    return (F.crc32(conv.cast("string")) % 4).cast("int")


def rebuild(
    conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 20
) -> DataFrame:
    """(conv, data): the turns of each rebuilt conversation, ``TURN`` bytes each.

    Texts are hashed and counted where they are read, so only ids move, once: conversations of a family
    (ids that share ``c - c % family``) meet in one shuffle, and the head's first three turns are
    spread over the family by a window.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    told = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    words = F.regexp_count(text_, F.lit(WORD))
    turns = conversations.where(F.col(id).isNotNull()).select(
        (F.col(id).cast("long") - F.col(id).cast("long") % family).alias("head"),
        F.col(id).cast("long").alias("conv"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            told.alias("told"),
            F.concat(F.substring(told, 1, 32), F.lpad(F.hex(words), 8, "0")).alias("hex"),
        ).alias("t"),
    )
    own = turns.repartition("head").groupBy("head", "conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    own = own.select("head", "conv", F.transform("ts", lambda t: t["hex"]).alias("ts"))
    lead = F.max(F.when(F.col("head") == F.col("conv"), F.slice("ts", 1, 3))).over(Window.partitionBy("head"))
    taken = first_turns(F.col("conv"))
    whole = F.concat(
        F.slice(F.coalesce("lead", F.array().cast("array<string>")), F.lit(1), taken),
        F.slice("ts", taken + 1, F.greatest(F.size("ts") - taken, F.lit(0))),
    )
    return own.withColumn("lead", lead).select("conv", F.unhex(F.array_join(whole, "")).alias("data"))


# one shard ---------------------------------------------------------------------------------


def _flat(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All turns of the rows, and where each row starts in them."""
    at = np.concatenate([[0], np.cumsum([len(b) // TURN for b in column])]).astype(np.int64)
    return np.frombuffer(b"".join(column), f"S{TURN}"), at


def sort_rows(ids: np.ndarray, at: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows in the order of their ids, shorter first, then by ``tie``; and how many first ids
    each row shares with the one before it (-1 for the first).

    The rows are a matrix padded with 0, taken ``TILE`` columns at a time; only rows still equal to a
    neighbour go to the next tile.
    """
    size = np.diff(at)
    order, n = np.argsort(tie, kind="stable"), len(size)
    common, alike = np.zeros(n, np.int64), np.ones(n, bool)  # alike: equal to the row before, so far
    alike[:1] = False
    column = 0
    while True:
        group = np.cumsum(~alike) - 1
        longest = np.zeros(group[-1] + 1 if n else 0, np.int64)
        np.maximum.at(longest, group, size[order])
        open_ = (np.bincount(group)[group] > 1) & (longest[group] > column) if n else np.zeros(0, bool)
        where = np.flatnonzero(open_)
        if not len(where):
            break
        rows = order[where]
        cells = column + np.arange(TILE)
        inside = cells[None, :] < size[rows][:, None]
        matrix = np.zeros((len(rows), TILE), np.int32)
        matrix[inside] = ids[(at[rows][:, None] + cells[None, :])[inside]]
        by = np.lexsort((*matrix.T[::-1], group[where]))
        order[where], matrix = rows[by], matrix[by]
        changed = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        pairs = np.flatnonzero(alike[where[1:]])
        equal = TILE - changed[pairs].sum(axis=1)
        common[where[1:][pairs]] += equal
        alike[where[1:][pairs]] = equal == TILE
        column += TILE
    common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    common[:1] = -1
    return order, common


def _keys(data: bytes) -> list[bytes]:
    """A key of 16 bytes for each prefix of a row, from none to all turns."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for i in range(0, len(data), TURN):
        h.update(data[i : i + TURN])
        out.append(h.copy().digest())
    return out


def fold(column: list[bytes], convs: np.ndarray | None, parts: list[bytes] | None, shard: int, whole: bool):
    """Nodes of the rows of one shard, as Arrow batches.

    Rows are conversations (``convs``), or boundary rows of the shards of the level below with what is known
    of the nodes on their path (``parts``, the five counts for each depth). A run of rows with equal first d
    turns is a node; ``reduceat`` over the runs of each depth, deepest first, gives its counts, and
    children add theirs to the run that holds them. Runs that touch the first or last row may go on in
    another shard: they leave as the path of that row, unless the shard is the ``whole`` table.
    """
    data, at = _flat(column)
    _, ids = np.unique(data, return_inverse=True)
    ids = (ids + 1).astype(np.int32)
    order, common = sort_rows(ids, at, convs if convs is not None else np.arange(len(column)))
    size, n = np.diff(at)[order], len(order)
    words = np.frombuffer(data.tobytes(), ">u4").reshape(-1, TURN // 4)[:, -1].astype(np.int64)
    start = at[:-1][order]
    if parts is not None:  # five counts for each depth of each row, one row more than turns
        table = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 5) for p in parts])
        place = (at[:-1] + np.arange(n))[order]
    conv_of = convs[order] if convs is not None else None
    if parts is None:
        edge_keys = {r: _keys(column[order[r]]) for r in {0, n - 1}}
        row_key = edge_keys.__getitem__
    else:
        all_keys = [_keys(column[order[r]]) for r in range(n)]
        row_key = all_keys.__getitem__
    carried = {r: np.zeros((size[r] + 1, 5), np.int64) for r in {0, n - 1}}
    for c in carried.values():
        c[:, 1] = _NOBODY
    by_size = np.argsort(size, kind="stable")
    sizes = size[by_size]
    active = np.zeros(0, np.int64)
    below = None  # nodes one deeper: first row, complete, conv, n, kids, leaves, saved, ends, keys
    held, held_rows = [], 0

    for depth in range(int(size.max()), -1, -1):
        fresh = by_size[np.searchsorted(sizes, depth) : np.searchsorted(sizes, depth, "right")]
        active = np.sort(np.concatenate([active, fresh]), kind="stable")
        runs = np.flatnonzero(common[active] < depth)
        first = active[runs]
        if parts is None:
            total, conv = np.diff(np.append(runs, len(active))), np.minimum.reduceat(conv_of[active], runs)
            kids, leaves, saved = (np.zeros(len(runs), np.int64) for _ in range(3))
        else:
            mine = table[place[active] + depth]
            total, kids, leaves, saved = (np.add.reduceat(mine[:, k], runs) for k in (0, 2, 3, 4))
            conv = np.minimum.reduceat(mine[:, 1], runs)
        done = np.ones(len(runs), bool)
        if not whole:
            done[0] &= active[0] != 0
            done[-1] &= active[-1] != n - 1
        if below is not None:
            up = np.searchsorted(first, below["first"], "right") - 1
            inner = below["done"]
            np.add.at(kids, up[inner], 1)
            np.add.at(leaves, up[inner], below["leaves"][inner])
            np.add.at(saved, up[inner], below["saved"][inner])
            held.append(_emit(below, up, done, conv, first, row_key, depth + 1, shard, n))
            held_rows += held[-1].num_rows
        leaves[done & (kids == 0)] = 1
        if depth:
            saved[done] += ((total - 1) * words[start[first] + depth - 1])[done]
        ends: list[str | None] = [None] * len(runs)
        if parts is None and len(fresh):
            owner = np.searchsorted(first, np.sort(fresh), "right") - 1
            cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
            listed = conv_of[np.sort(fresh)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                run = int(owner[a])
                if done[run]:
                    ends[run] = hashlib.sha256(",".join(map(str, listed[a:b].tolist())).encode()).hexdigest()
                else:  # the ids go on in other shards, perhaps: pieces in their order, hashed together later
                    key = row_key(0 if first[run] == 0 else n - 1)[depth]
                    for i in range(a, b, 8192):
                        piece = listed[i : min(b, i + 8192)].tolist()
                        yield _rows("ends", shard, 1, conv_id=[piece[0]], key=[key], data=[",".join(map(str, piece)).encode()])
        for run in {0, len(runs) - 1}:
            if not done[run]:
                carried[0 if first[run] == 0 else n - 1][depth] = total[run], conv[run], kids[run], leaves[run], saved[run]
        keys = None if parts is None else [row_key(int(r))[depth] for r in first]
        below = dict(first=first, done=done, conv=conv, n=total, kids=kids, leaves=leaves, saved=saved, ends=ends, keys=keys)
        if held_rows > 20_000:
            yield from held
            held, held_rows = [], 0
    held.append(_emit(below, None, None, None, None, row_key, 0, shard, n))
    yield from held
    if not whole:
        for row, counts in carried.items():
            yield _rows("path", shard, 1, data=[column[order[row]]], parts=[counts.tobytes()])


def _emit(below, up, done, conv, first, row_key, depth, shard, n) -> pa.RecordBatch:
    """The complete nodes of a depth, now that the runs of their parents are known."""
    mine = np.flatnonzero(below["done"])
    parent = parent_key = [None] * len(mine)
    if up is not None:
        known = done[up[mine]]
        parent = pa.array(conv[up[mine]], pa.int64(), mask=~known)
        open_keys = {r: row_key(0 if first[r] == 0 else n - 1)[depth - 1] for r in np.flatnonzero(~done).tolist()}
        parent_key = [None if k else open_keys[p] for k, p in zip(known.tolist(), up[mine].tolist())]
    columns = {name: below[k][mine] for name, k in zip(("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ("conv", "n", "kids", "leaves", "saved"))}
    return _rows(
        "node", shard, len(mine), **columns, depth=np.full(len(mine), depth), parent_conv_id=parent, parent_key=parent_key,
        ends=[below["ends"][i] for i in mine.tolist()], key=[below["keys"][i] for i in mine.tolist()] if below["keys"] else [None] * len(mine),
    )


# all shards -------------------------------------------------------------------------------


def _folded(rows: DataFrame, level: int, whole: bool) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        shard = level << 32 | TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        data = [x for b in got for x in b.column("data").to_pylist()]
        if level:
            yield from fold(data, None, [x for b in got for x in b.column("parts").to_pylist()], shard, whole)
        else:
            yield from fold(data, np.concatenate([b.column("conv").to_numpy() for b in got]), None, shard, whole)

    return rows.mapInArrow(run, _OUT)


def _hash_ends(batches):
    """Rows come by key and first id: the pieces of a key are one text, hashed as it passes."""
    key, h = None, None
    for batch in batches:
        out = []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
            if k == key:
                h.update(b",")
            else:
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            h.update(piece)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names=["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends"])


def prefix_trie(
    conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 20
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation ``c - c % family`` (h by
    ``first_turns``) and its own turns after its first h. A node is a distinct sequence of first d turns.

    1. Each turn becomes 20 bytes (128 bits of the SHA-256 of role and text, and its words); texts stay
       where they are read. A conversation becomes one row of them.
    2. Rows are dealt by range of (turns, conversation), so a third of all conversations that are equal, or share
       their first turns, still fall into many shards of about ``SHARD`` bytes.
    3. A shard sorts its rows as padded matrices of turn ids and folds them into nodes (``fold``). Nodes that touch
       its first or last row leave as two path rows with their counts.
    4. Path rows are sharded and folded again, until one shard holds them all; each level has at most an
       eighth of the rows of the one below.
    5. Parents that were open when their children left are looked up per (shard, parent); the ids that
       end at an open node are hashed in order by one streaming task, as SHA-256 is a chain.

    Turns come by number, null first; rows of one number by the SHA-256 (lowercase hex) of the length of the role, a
    colon, role and text. Null roles and texts are empty; rows without a conversation id belong to none
    and are left out; repeated rows are turns of their own. A conversation that keeps no turn is a member of
    the root alone. An empty table has no node. Other columns are not looked at. The turns of
    one conversation, 20 bytes each, have to fit a row.
    """
    spark = conversations.sparkSession
    rows = cut_lineage(rebuild(conversations, id, turn, role, text, family))
    levels, level, whole = [], 0, False
    shards = blocks.shards(spark)
    while True:
        n, size = rows.agg(F.count("*"), F.sum(F.length("data"))).first()
        if not n:
            break
        if level:
            shards = min(-(-size // SHARD), -(-n // 16))
            whole = shards <= 1
        else:
            shards = max(shards, -(-size // SHARD))
        order = ["data", "conv"] if not level else ["data"]
        dealt = rows.coalesce(1) if whole else rows.repartitionByRange(int(shards), *order)
        out = cut_lineage(_folded(dealt, level, whole))
        levels.append(out)
        if whole:
            break
        rows, level = out.where("kind = 'path'").select("data", "parts"), level + 1
    if not levels:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionAll(more)
    nodes = out.where("kind = 'node'").drop("kind", "data", "parts")
    shared = nodes.where("key IS NOT NULL")  # nodes that touched a border of a first shard
    hashed = (
        levels[0].where("kind = 'ends'").select("key", F.col("conv_id").alias("from"), "data")
        .repartition("key").sortWithinPartitions("key", "from").select("key", "data").mapInArrow(_hash_ends, "key binary, ends string")
    )
    shared = shared.drop("ends").join(hashed, "key", "left")
    every = nodes.where("key IS NULL").unionByName(shared)
    known = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_conv"))
    wanted = nodes.where("parent_key IS NOT NULL").select("shard", "parent_key").distinct().join(known, "parent_key")
    every = every.join(wanted, ["shard", "parent_key"], "left")
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "open_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )
