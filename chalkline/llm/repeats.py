"""Remove repeated passages: anchors at difference-cover positions meet, then extend to whole windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks
from chalkline.llm.words import Words, slices

# fixed values: perfect difference sets; each difference modulo the period occurs once
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
NULL_ID = 2**63 - 1
_SECOND = 0xD6E8FEB86659FD93
_SHARDED = "shard int, block int, data binary, n long, total long"
_BLOCKED = "block int, data binary, n long, total long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least six words (or any, for short windows).

    For all i and j there is a d below the period with i + d and j + d both in the cover, so two
    equal windows hold an aligned anchor of window - period + 1 words.
    """
    fit = [v for v in COVERS if window - v + 1 >= min(6, max(1, window // 2))]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


class Finder:
    """Anchors and windows of the texts of one slice."""

    def __init__(self, window: int):
        self.window = window
        self.period, cover = cover_for(window)
        self.in_cover = np.zeros(self.period, bool)
        self.in_cover[list(cover)] = True

    def anchors(self, w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, 40-bit key) of the anchors."""
        at, key = w.grams(hashes, self.window - self.period + 1)
        chosen = self.in_cover[(at - w.first[w.row[at]]) % self.period]
        return at[chosen], key[chosen] >> np.uint64(24)

    def candidates(self, w: Words, hashes: np.ndarray, repeated: np.ndarray):
        """(first word, hash, second hash) of all windows that hold a repeated anchor."""
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        at, key = self.anchors(w, hashes)
        if not len(at) or not len(repeated):
            return none
        place = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
        at = at[repeated[place] == key]
        if not len(at):
            return none
        change = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(change, np.maximum(at - self.period + 1, w.first[w.row[at]]), 1)
        np.add.at(change, at + 1, -1)
        near = np.cumsum(change[:-1]) > 0
        start, full = w.grams(hashes, self.window)
        chosen = near[start]
        second = w.grams(hashes, self.window, _SECOND)[1]
        return start[chosen], full[chosen], (second[chosen] >> np.uint64(32)).astype(np.uint32)


def _pack40(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


_WINDOW = np.dtype([("h", "<u8"), ("c", "<u4"), ("id", "<i8"), ("at", "<u4")])


def _by(groups: np.ndarray, values: np.ndarray):
    """(group, its values) for values that carry a group number."""
    order = np.argsort(groups, kind="stable")
    g, v = groups[order], values[order]
    for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1) if len(g) else ():
        yield int(g[part[0]]), v[part]


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in names.split(", "))])
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _texts(batches):
    """Slices of (ids, texts) with the words of the texts."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            yield part.column("id").to_numpy().astype(np.int64), part.column("text"), Words(part.column("text"))


def _first_of(windows: np.ndarray) -> np.ndarray:
    """Places of the windows that are the earliest of their sequence; several if id and start are equal, too."""
    order = np.lexsort((windows["at"], windows["id"], windows["c"], windows["h"]))
    s = windows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["h"][1:] != s["h"][:-1]) | (s["c"][1:] != s["c"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (s["id"] == s["id"][head]) & (s["at"] == s["at"][head])
    return order[same]


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` consecutive words of its document covers it, whose word
    sequence also starts earlier: in a smaller id (null is the largest), or earlier in the same
    id. Windows are judged on the texts as given. The first occurrence always stays.

    1. Each scan task hashes the anchors at the cover positions and sends each key once or, if it
       has it more often, twice. Keys that come together twice are repeated.
    2. The task that scans the same split again extends each repeated anchor to the windows around
       it, and sends the earliest start of each different window. The earliest of all wins.
    3. A third scan removes the words of the candidate windows that did not win.

    What a step learns for a split is kept in a file of the shared folder (see ``blocks``), so the
    texts never move; a passage that fills a third of all rows is one entry a task. Windows are
    told apart by 96 bits. ``docs`` must give the same splits when it is read again, as stored
    tables and checkpoints do; other inputs fail, and are to be stored first. Null texts count as
    empty, an empty table gives an empty table, other columns are not looked at.
    """
    spark = docs.sparkSession
    folder, count = blocks.shared_folder(spark, "repeats"), blocks.shards(spark)
    rows = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    finder = Finder(window)

    def send_anchors(batches):
        from pyspark import TaskContext

        block, seen, held, size = TaskContext.get().partitionId(), (0, 0), [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys = np.repeat(keys, np.minimum(n, 2))
            return _batch([(s, block, _pack40(k), 0, 0) for s, k in _by((keys % np.uint64(count)).astype(np.int64), keys)], _SHARDED)

        for ids, _, w in _texts(batches):
            seen = blocks.checksum(ids, seen)
            held.append(finder.anchors(w, w.hashes())[1])
            size += len(held[-1])
            if size > 4 << 20:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        yield _batch([(block % count, block, b"", seen[0], np.uint64(seen[1]).view(np.int64).item())], _SHARDED)

    def meet_anchors(batches):
        keys, owners = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["n"] or not row["data"]:
                    yield _batch([(row["block"], b"", row["n"], row["total"])], _BLOCKED)
                else:
                    keys.append(_unpack40(row["data"]))
                    owners.append(np.full(len(keys[-1]), row["block"], np.int64))
        if keys:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            same = key[1:] == key[:-1]
            twice = np.zeros(len(key), bool)
            twice[1:] |= same
            twice[:-1] |= same
            twice[1:] &= ~(same & (owner[1:] == owner[:-1]))  # once a block
            yield _batch([(b, _pack40(k), 0, 0) for b, k in _by(owner[twice], key[twice])], _BLOCKED)

    def keep_anchors(batches):
        keys, marks = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["data"]:
                    keys.setdefault(row["block"], []).append(_unpack40(row["data"]))
                else:
                    marks[row["block"]] = row["n"], row["total"]
        for block, mark in marks.items():
            found = np.unique(np.concatenate(keys.get(block, [np.zeros(0, np.uint64)])))
            blocks.save(folder, f"anchors-{block}", keys=found, mark=np.array(mark, np.int64))
        yield _batch([(b, b"", n, t) for b, (n, t) in marks.items()], _BLOCKED)

    def check(side, seen):
        if not len(side) and not seen[0]:
            return
        if not len(side) or [int(x) for x in side["mark"].view(np.uint64)] != [*seen]:
            raise RuntimeError("a split holds other rows than before; store the table first")

    def send_windows(batches):
        from pyspark import TaskContext

        block, seen, held, size = TaskContext.get().partitionId(), (0, 0), [], 0
        side = blocks.load(folder, f"anchors-{block}")
        repeated = side.get("keys", np.zeros(0, np.uint64))

        def flush():
            all_ = np.concatenate(held)
            first = np.sort(_first_of(all_))  # in the order of the texts, which packs better
            won = all_[first]
            return _batch([(s, block, x.tobytes(), 0, 0) for s, x in _by((won["h"] % np.uint64(count)).astype(np.int64), won)], _SHARDED)

        for ids, _, w in _texts(batches):
            seen = blocks.checksum(ids, seen)
            start, h, c = finder.candidates(w, w.hashes(), repeated)
            got = np.zeros(len(start), _WINDOW)
            row = w.row[start]
            got["h"], got["c"], got["id"], got["at"] = h, c, ids[row], start - w.first[row]
            held.append(got)
            size += len(got)
            if size > 2 << 20:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        check(side, seen)

    def meet_windows(batches):
        data, owners = [], []
        for batch in batches:
            for row in batch.to_pylist():
                data.append(np.frombuffer(row["data"], _WINDOW))
                owners.append(np.full(len(data[-1]), row["block"], np.int64))
        if data:
            windows, owner = np.concatenate(data), np.concatenate(owners)
            first = _first_of(windows)
            yield _batch([(b, x.tobytes(), 0, 0) for b, x in _by(owner[first], windows[first])], _BLOCKED)

    def keep_windows(batches):
        won = {}
        for batch in batches:
            for row in batch.to_pylist():
                won.setdefault(row["block"], []).append(np.frombuffer(row["data"], _WINDOW))
        for block, parts in won.items():
            x = np.concatenate(parts)
            blocks.save(folder, f"windows-{block}", won=x[np.lexsort((x["at"], x["id"], x["c"], x["h"]))])
        yield _batch([(b, b"", 0, 0) for b in won], _BLOCKED)

    def remove(batches):
        from pyspark import TaskContext

        block, seen = TaskContext.get().partitionId(), (0, 0)
        side = blocks.load(folder, f"anchors-{block}")
        repeated = side.get("keys", np.zeros(0, np.uint64))
        won = blocks.load(folder, f"windows-{block}").get("won", np.zeros(0, _WINDOW))
        won_h = np.ascontiguousarray(won["h"])
        for ids, texts, w in _texts(batches):
            seen = blocks.checksum(ids, seen)
            start, h, c = finder.candidates(w, w.hashes(), repeated)
            row = w.row[start]
            place, stays = np.searchsorted(won_h, h), np.zeros(len(start), bool)
            for step in (0, 1, 2):  # rows that share an id can have several winners of one hash
                j = np.minimum(place + step, max(0, len(won) - 1))
                if len(won):
                    x = won[j]
                    stays |= (x["h"] == h) & (x["c"] == c) & (x["id"] == ids[row]) & (x["at"] == start - w.first[row])
            gone = start[~stays]
            change = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(change, gone, 1)
            np.add.at(change, np.minimum(gone + window, len(w.start)), -1)
            keep = np.cumsum(change[:-1]) == 0
            out = []
            for k, t in enumerate(texts.to_pylist()):
                a, b = int(w.first[k]), int(w.first[k + 1])
                words, mask = t.split(), keep[a:b]
                removed = int(b - a - mask.sum())
                if removed:
                    words = [x for x, m in zip(words, mask.tolist()) if m]
                i = int(ids[k])
                out.append((None if i == NULL_ID else i, b - a, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            yield _batch(out, _RESULT)
        check(side, seen)

    def settle(send, meet, keep):
        sent = blocks.by_shard(rows.mapInArrow(send, _SHARDED), count)
        met = sent.mapInArrow(meet, _BLOCKED).repartition(count, "block")
        met.mapInArrow(keep, _BLOCKED).agg(F.count("*")).collect()

    settle(send_anchors, meet_anchors, keep_anchors)
    settle(send_windows, meet_windows, keep_windows)
    return rows.mapInArrow(remove, _RESULT).withColumnRenamed("doc_id", id)
