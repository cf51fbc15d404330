"""Benchmark decontamination: item windows meet documents under their rarest shingle, then whole windows are compared."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks
from chalkline.llm.words import Words, column_bytes, slices
from chalkline.session import cut_lineage

#: words of a shingle; windows of fewer words are one shingle
SHINGLE = 3
#: (window, item) pairs of one block of the index, which a task holds one at a time
BLOCK = 1 << 18
_SIEVE = 22
_RESULT = "doc_id {}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

# fixed values: what separates words, all of ASCII but digits and letters
_SPACE = np.ones(256, bool)
_SPACE[128:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _SPACE[ord(_a) : ord(_b) + 1] = False
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_SPACE] = 32


class Text(NamedTuple):
    """The words of a column of texts, lower-cased, and the same texts with one space after each word."""

    words: Words
    hashes: np.ndarray
    even: bytes
    at: np.ndarray
    end: np.ndarray


def read_texts(column: pa.Array) -> Text:
    buf, at = column_bytes(column)
    plain = _PLAIN[buf]
    words = Words(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(plain)]))
    word = plain != 32
    kept = word.copy()
    kept[1:] |= word[:-1]  # the one separator behind a word
    before = np.concatenate([[0], np.cumsum(kept)])
    return Text(words, words.hashes(), plain[kept].tobytes(), before[words.start], before[words.end])


def shingles(t: Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all runs of ``size`` words in one text; runs of other sizes have other hashes."""
    at, h = t.words.grams(t.hashes, size)
    return at, h * np.uint64(2 * size + 1)


# the index of the benchmark ---------------------------------------------------------------


def item_windows(items: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(item, window, place): each different window of each item as bytes, its words joined by a space.

    A window holds ``window`` consecutive words; an item of fewer words, but not none, is one window.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                t = read_texts(part.column("text"))
                names = part.column("item").to_pylist()
                out = []
                for r, name in enumerate(names):
                    a, b = int(t.words.first[r]), int(t.words.first[r + 1])
                    for s in range(a, max(b - window, a) + 1) if b > a else ():
                        out.append((name, t.even[t.at[s] : t.end[min(s + window, b) - 1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["item", "window"]
                )

    rows = items.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "item string, window binary").distinct()


def _window_shingles(windows: list[bytes]) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the windows, and for each shingle its window, offset, size and hash."""
    t = read_texts(pa.array(windows, pa.large_binary()))
    count = np.diff(t.words.first)
    which, offset, kind, value = [], [], [], []
    for size in range(1, SHINGLE + 1):
        at, h = shingles(t, size)
        row = t.words.row[at]
        fit = (count[row] == size) if size < SHINGLE else count[row] >= size
        which.append(row[fit])
        offset.append(at[fit] - t.words.first[row[fit]])
        kind.append(np.full(int(fit.sum()), size, np.int8))
        value.append(h[fit])
    return t, *(np.concatenate(x) for x in (which, offset, kind, value))


def _write_blocks(rows: DataFrame, folder: str, name: str, pairs: int, pack) -> int:
    """Write the rows as files of about ``BLOCK`` rows each, one a task, and return how many there may be."""
    count = max(1, -(-pairs // BLOCK))

    def run(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if got:
            blocks.save(folder, f"{name}-{TaskContext.get().partitionId()}", **pack(pa.Table.from_batches(got).combine_chunks()))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["n"])

    rows.coalesce(count).mapInArrow(run, "n int").agg(F.count("*")).collect()
    return count


def _pack_shingles(t: pa.Table) -> dict[str, np.ndarray]:
    size, value = t.column("size").to_numpy(), t.column("shingle").to_numpy().view(np.uint64)
    order = np.lexsort((size, value))
    return {"shingle": value[order], "size": size[order]}


def _pack_windows(t: pa.Table) -> dict[str, np.ndarray]:
    """Windows in the order of their prefix shingle, each once, and its items."""
    window, item = t.column("window").to_pylist(), t.column("item").to_pylist()
    key = t.column("shingle").to_numpy().view(np.uint64)
    order = np.array(sorted(range(len(window)), key=lambda i: (int(key[i]), window[i], item[i])), np.int64)
    new = [k == 0 or window[order[k]] != window[order[k - 1]] for k in range(len(order))]
    head = order[np.flatnonzero(new)]
    text = [window[i] for i in head]
    words = read_texts(pa.array(text, pa.large_binary()))
    span = np.diff(words.words.first)
    names = sorted(set(item))
    number = {x: i for i, x in enumerate(names)}
    return {
        "shingle": key[head], "size": t.column("size").to_numpy()[head], "offset": t.column("offset").to_numpy()[head].astype(np.int64),
        "span": span, "run": words.words.runs(words.hashes, words.words.first[:-1], words.words.first[1:]),
        "text": np.frombuffer(b"".join(text), np.uint8), "at": np.concatenate([[0], np.cumsum([len(x) for x in text])]),
        "item_at": np.append(np.flatnonzero(new), len(order)), "item": np.array([number[item[i]] for i in order], np.int64),
        "names": np.frombuffer("\0".join(names).encode(), np.uint8),
    }


class _Blocks:
    """The blocks of an index, one in memory at a time; a single one is kept."""

    def __init__(self, folder: str, name: str, count: int):
        self.folder, self.name, self.count, self.held = folder, name, count, {}

    def __iter__(self):
        for i in range(self.count):
            if i not in self.held:
                block = blocks.load(self.folder, f"{self.name}-{i}")
                if block:
                    sieve = np.zeros(1 << _SIEVE, bool)
                    sieve[block["shingle"] >> np.uint64(64 - _SIEVE)] = True
                    block |= {"sieve": sieve, "sizes": np.unique(block["size"]).tolist(), "id": i}
                self.held = {i: block}
            if self.held[i]:
                yield self.held[i]


def _met(t: Text, block: dict, made: dict):
    """(first word, first entry, last entry + 1) of the shingles of the texts that the block holds, by shingle size."""
    for size in block["sizes"]:
        if size not in made:
            made[size] = shingles(t, size)
        at, h = made[size]
        some = np.flatnonzero(block["sieve"][h >> np.uint64(64 - _SIEVE)])
        first, last = np.searchsorted(block["shingle"], h[some]), np.searchsorted(block["shingle"], h[some], "right")
        real = first < last
        yield at[some[real]], first[real], last[real]


def _parts(batches, limit: int = 4 << 20):
    for batch in batches:
        yield from slices(batch, "text", limit)


# the operator -----------------------------------------------------------------------------


def _rarity(docs: DataFrame, folder: str, count: int) -> DataFrame:
    """(shingle, n): how often the shingles of the index occur in all documents."""

    def run(batches):
        index, seen = _Blocks(folder, "shingles", count), {}
        for part in _parts(batches):
            t, made = read_texts(part.column("text")), {}
            for block in index:
                for _, first, _ in _met(t, block, made):
                    n = seen.setdefault(block["id"], np.zeros(len(block["shingle"]), np.int64))
                    n += np.bincount(first, minlength=len(n))
        for block in index:
            n = seen.get(block["id"], np.zeros(0, np.int64))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(block["shingle"][some].view(np.int64)), pa.array(n[some])], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _explode(windows: DataFrame) -> DataFrame:
    """(window, shingle, size, offset) of different windows."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                column = batch.column("window").slice(i, 4096)
                _, which, offset, size, value = _window_shingles(column.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [column.take(pa.array(which)), pa.array(value.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(offset.astype(np.int32))],
                    names=["window", "shingle", "size", "offset"],
                )

    return windows.mapInArrow(run, "window binary, shingle long, size int, offset int")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are lower-cased runs of ASCII digits and letters and of all characters beyond ASCII. A
    document word is hit if an occurrence of an item window covers it.

    1. Each different window is a set of shingles of three words. All documents are scanned once to count how
       often the shingles of the items occur. As all of a window's shingles are needed, one suffices as its prefix:
       the rarest (ties by hash). A window with a shingle that never occurs is out.
    2. The prefixes, with their place in the window, are written in blocks of about ``BLOCK`` (window, item)
       pairs to the shared folder. Tasks that scan the documents again look up their shingles there, block
       after block, so memory is bounded whatever the size of the benchmark, and neither documents nor their
       shingles are shuffled: a passage that a third of all rows hold is no hot key.
    3. A met prefix says where its window would start and end. Those that leave the document are out; the
       others are compared as a whole, by hash and then byte by byte.

    Null texts have no words and hold no item; items without words match nothing. Null item ids count as
    an item named by the empty string; rows that repeat an item id are one item. Repeated rows of
    ``docs`` give rows of their own, null ids stay, an empty table gives an empty one, and no item leaves all
    documents clean. Other columns are not looked at. Long texts are read whole.
    """
    spark = docs.sparkSession
    folder = blocks.shared_folder(spark, "leaks")
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    pairs = cut_lineage(item_windows(items, item_id, item_text, window))
    different = pairs.select("window").distinct()
    exploded = cut_lineage(_explode(different))
    vocabulary = exploded.select("shingle", "size").distinct()
    n_blocks = _write_blocks(vocabulary, folder, "shingles", exploded.count(), _pack_shingles)
    counted = cut_lineage(_rarity(rows, folder, n_blocks))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "size", "offset")).alias("r")
    prefix = exploded.join(counted, "shingle", "left").groupBy("window").agg(rare).where("r.n > 0")
    index = pairs.join(prefix.select("window", "r.shingle", "r.size", "r.offset"), "window")
    n_index = _write_blocks(index, folder, "windows", pairs.count(), _pack_windows)

    def run(batches):
        index = _Blocks(folder, "windows", n_index)
        for part in _parts(batches):
            t, made = read_texts(part.column("text")), {}
            w, n = t.words, part.num_rows
            first, last = w.first[:-1], w.first[1:]
            change = np.zeros(len(t.at) + 1, np.int32)
            found: dict[int, set[str]] = {}
            for block in index:
                names = None
                for at, a, b in _met(t, block, made):
                    at, entry = np.repeat(at, b - a), np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
                    start, row = at - block["offset"][entry], w.row[at]
                    end = start + block["span"][entry]
                    inside = (start >= first[row]) & (end <= last[row])
                    start, end, row, entry = start[inside], end[inside], row[inside], entry[inside]
                    alike = w.runs(t.hashes, start, end) == block["run"][entry]
                    start, end, row, entry = start[alike], end[alike], row[alike], entry[alike]
                    mine, theirs = memoryview(t.even), memoryview(block["text"])
                    text_at = block["at"].tolist()
                    spans = zip(t.at[start].tolist(), t.end[end - 1].tolist(), entry.tolist())
                    same = np.array([mine[i:j] == theirs[text_at[e] : text_at[e + 1]] for i, j, e in spans], bool)
                    if not same.any():
                        continue
                    np.add.at(change, start[same], 1)
                    np.add.at(change, end[same], -1)
                    if names is None:
                        names = block["names"].tobytes().decode().split("\0")
                    held = np.unique(np.stack([row[same], entry[same]], axis=1), axis=0)
                    for r, e in held.tolist():
                        found.setdefault(r, set()).update(names[i] for i in block["item"][block["item_at"][e] : block["item_at"][e + 1]])
            hit = np.bincount(w.row, weights=np.cumsum(change[:-1])[: len(w.row)] > 0, minlength=n).astype(np.int64)
            empty = hashlib.sha256(b"").hexdigest()
            told = [hashlib.sha256(",".join(sorted(found[r])).encode()).hexdigest() if r in found else empty for r in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), pa.array(np.diff(w.first)), pa.array(hit), pa.array([len(found.get(r, ())) for r in range(n)], pa.int64()),
                    pa.array(told), pa.array(hit > 0),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return rows.mapInArrow(run, _RESULT.format(kind)).withColumnRenamed("doc_id", id)
