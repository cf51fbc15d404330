"""Pack token pieces into sequences with a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.words import slices
from chalkline.session import cut_lineage

# ---------------------------------------------------------------- tokens


# fixed value: the pattern by which byte-level tokenizers of this kind cut a text
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter a tokenizer file writes for each byte: visible ones as they are, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level file, where it can by a faster merger of the same pairs.

    If the id of each merged token follows the order of the merges, then the merges are ranks, and
    ``tiktoken`` over the same vocabulary and cuts yields the same ids. Files that are not of this
    kind, texts that hold the string of an added token, and texts that it cannot take go to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values() if t.content]
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
        ordered = all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merges))
        if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or spec.get("normalizer") or not ordered:
            return None
        letters, special = _byte_letters(), {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("of a file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        ids = None
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                ids = self.fast.encode_ordinary(text)
            except BaseException as error:  # the pattern engine gives up on some very long runs by a panic
                if type(error).__name__ != "PanicException":
                    raise
        if ids is None:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}  # a worker serves many tasks

PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, id: str, text: str, capacity: int, end_id: int = 0) -> DataFrame:
    """id, piece, start, length, crc of every piece; a document's ids end with ``end_id``.

    Only documents above ``capacity`` are cut, into full pieces; the first takes what is left over.
    """

    def cut(batches: Iterator[pa.RecordBatch]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    data = memoryview(encoder.encode(text) + end)
                    n = len(data) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        to = at + ((n - 1) % capacity + 1 if k == 0 else capacity)
                        rows.append((i, k, at, to - at, zlib.crc32(data[4 * at : 4 * to])))
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE.types)], schema=PIECE)

    whole = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.mapInArrow(cut, "id long, piece int, start long, length long, crc long")


# ---------------------------------------------------------------- genetic algorithm


def best_fit(sizes, items, bins: list[int], capacity: int, assign) -> None:
    """Put ``items`` one by one where the least room is left; ``bins`` holds the fill of each bin."""
    room = sorted((capacity - f, b) for b, f in enumerate(bins) if f < capacity)
    for i in items:
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append(0)
        assign[i] = b
        bins[b] += s
        if free > s:
            insort(room, (free - s, b))


def cost(sizes, assign, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller and emptier ones rather than even ones."""
    fill = np.bincount(assign, weights=sizes) if len(assign) else np.zeros(0)
    fill = fill[fill > 0]
    return len(fill), -float(((fill / capacity) ** 2).sum())


def _rebuild(sizes, kept, groups: list[np.ndarray], capacity: int) -> np.ndarray:
    """Bins of ``kept`` (old bin or -1 per item) and ``groups`` as they are, all other items best-fitted."""
    assign = np.full(len(sizes), -1, np.int64)
    held = kept >= 0
    if held.any():
        assign[held] = np.unique(kept[held], return_inverse=True)[1]
    n = int(assign.max(initial=-1)) + 1
    for k, g in enumerate(groups):
        assign[g] = n + k
    n += len(groups)
    done = assign >= 0
    bins = np.bincount(assign[done], weights=sizes[done], minlength=n).astype(np.int64).tolist()
    best_fit(sizes, np.flatnonzero(~done), bins, capacity, assign)  # items are in falling size
    return assign


def crossover(sizes, a, b, capacity: int, rng) -> np.ndarray:
    """Inject well-filled bins of ``b`` whole into ``a``; bins of ``a`` that share a document with them are
    dissolved, and their other documents are best-fitted."""
    fill = np.bincount(b, weights=sizes)
    order = np.argsort(-fill, kind="stable")
    good = order[: max(1, int((fill > 0).sum()) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 3), replace=False)] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    kept = np.where(hit[a], -1, a)
    items = np.flatnonzero(injected)
    by_bin = items[np.argsort(b[items], kind="stable")]
    groups = np.split(by_bin, np.flatnonzero(np.diff(b[by_bin])) + 1) if len(by_bin) else []
    return _rebuild(sizes, kept, groups, capacity)


def mutate(sizes, a, capacity: int, rng) -> np.ndarray:
    """Dissolve the emptiest bins and a few others."""
    fill = np.bincount(a, weights=sizes)
    used = np.flatnonzero(fill > 0)
    p = (capacity + 1 - fill[used]).astype(float) ** 2
    gone = rng.choice(used, min(len(used), max(2, len(used) // 25)), replace=False, p=p / p.sum())
    hit = np.zeros(len(fill), bool)
    hit[gone] = True
    return _rebuild(sizes, np.where(hit[a], -1, a), [], capacity)


def founder(sizes, capacity: int, rng=None) -> np.ndarray:
    """Best fit in falling size, or in a shaken order."""
    n = len(sizes)
    order = range(n) if rng is None else np.argsort(-sizes * rng.uniform(0.8, 1.2, n), kind="stable")
    assign = np.full(n, -1, np.int64)
    best_fit(sizes, order, [], capacity, assign)
    return assign


def evolve(sizes, population: list[np.ndarray], capacity: int, rng, size: int, generations: int) -> list[np.ndarray]:
    """The population after some generations, best first. Ends at once when no packing can be better."""
    least = -(-int(sizes.sum()) // capacity)
    scored = sorted(((cost(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    for g in range(generations):
        if scored[0][0][0] <= least:
            break
        children = []
        for _ in range(size // 2):
            i, j = sorted(rng.integers(0, len(scored), 2))  # the better one gives bins, the worse one takes them
            child = crossover(sizes, scored[j][2], scored[i][2], capacity, rng)
            children.append(mutate(sizes, child, capacity, rng) if rng.random() < 0.5 else child)
        children.append(mutate(sizes, scored[0][2], capacity, rng))
        pool = scored + [(cost(sizes, c, capacity), len(scored) + k, c) for k, c in enumerate(children)]
        pool.sort(key=lambda x: x[:2])
        best, seen = [], set()
        for c, _, p in pool:  # equal costs are nearly always equal packings
            if c not in seen and len(best) < size:
                seen.add(c)
                best.append((c, len(best), p))
        scored = best
    return [p for _, _, p in scored]


_STATE = "shard long, island int, sizes binary, packings array<binary>"


def _order(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(
        ["length", "id", "piece", "start", "crc"], ascending=[False, True, True, True, True], ignore_index=True, kind="stable"
    )


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    shard_items: int = 2000,
    islands: int = 2,
    population: int = 6,
    epochs: int = 3,
    generations: int = 6,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (id, piece, start, length, crc).

    Rows are dealt to shards of about ``shard_items`` pieces by row number, so no key can fill a
    shard. Each shard has ``islands`` populations. An epoch is one grouped stage: an island evolves
    its packings and sends the best one to the next island, where it joins the population of the
    next epoch. At the end the best packing of all islands is laid out. Full pieces are sequences
    of their own. A shard leaves at most about one sequence part empty, so shards cost less than
    one sequence in ``shard_items`` pieces.
    """
    pieces = cut_lineage(pieces)  # fixes the row numbers
    shards = max(1, round(pieces.count() / shard_items))
    pieces = pieces.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))

    def found(key, items: pd.DataFrame) -> pd.DataFrame:
        sizes = _order(items)["length"].to_numpy(np.int64)
        blob = sizes.astype("<i4").tobytes()
        rows = []
        for island in range(islands):
            rng = np.random.default_rng([int(key[0]), island])
            first = founder(sizes, capacity)
            optimal = first.max(initial=-1) + 1 <= -(-int(sizes.sum()) // capacity)
            more = [] if optimal else [founder(sizes, capacity, rng) for _ in range(population - 1)]
            rows.append((int(key[0]), island, blob, [p.astype("<i4").tobytes() for p in [first, *more]]))
        return pd.DataFrame(rows, columns=["shard", "island", "sizes", "packings"])

    def epoch(number: int):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            shard, island = map(int, key)
            own = rows[rows["sizes"].notna()].iloc[0]
            sizes = np.frombuffer(own["sizes"], "<i4").astype(np.int64)
            # own packings first, then immigrants in a fixed order
            blobs = list(own["packings"]) + sorted(b for p in rows.loc[rows["sizes"].isna(), "packings"] for b in p)
            packings = [np.frombuffer(b, "<i4").astype(np.int64) for b in blobs]
            rng = np.random.default_rng([shard, island, number + 1])
            packings = evolve(sizes, packings, capacity, rng, population, generations)
            out = [p.astype("<i4").tobytes() for p in packings]
            moved = [(shard, (island + 1) % islands, None, out[:1])] if islands > 1 else []
            return pd.DataFrame([(shard, island, own["sizes"], out), *moved], columns=["shard", "island", "sizes", "packings"])

        return run

    state = pieces.where(F.col("length") < capacity).groupBy("shard").applyInPandas(found, _STATE)
    for k in range(epochs):
        state = state.groupBy("shard", "island").applyInPandas(epoch(k), _STATE)

    def place(key, items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        items = _order(items)
        short = items["length"].to_numpy() < capacity
        sizes = items["length"].to_numpy(np.int64)
        bins = np.empty(len(items), np.int64)
        bins[~short] = np.arange((~short).sum())
        if short.any():
            found = sorted(b for p in best["packings"] for b in p)
            packings = [np.frombuffer(b, "<i4").astype(np.int64) for b in found]
            chosen = min(packings, key=lambda p: cost(sizes[short], p, capacity))
            bins[short] = np.unique(chosen, return_inverse=True)[1] + (~short).sum()
        shard = int((items["shard"].iloc[0] if len(items) else 0))
        at = pd.Series(sizes).groupby(bins).cumsum().to_numpy() - sizes
        return items.drop(columns="shard").assign(sequence_id=(shard << 32) + bins, offset=at)

    best = state.where(F.col("sizes").isNotNull()).select("shard", F.slice("packings", 1, 1).alias("packings"))
    return (
        pieces.groupBy("shard")
        .cogroup(best.groupBy("shard"))
        .applyInPandas(place, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, **settings
) -> DataFrame:
    """One row per piece of every row of ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level tokenizer file, which every executor can read. Null
    and empty texts are one piece that holds ``end_id`` alone; null and repeated ids are packed as
    any other row. An empty table gives an empty table; other columns are not looked at.
    """
    packed = pack(token_pieces(docs, tokenizer, id, text, capacity, end_id), capacity, **settings)
    return packed.withColumnsRenamed({"id": id, "crc": "ids_crc32"})
