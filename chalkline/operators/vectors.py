"""E and X: vector search, exact mutual neighbours and weighted text search."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators.ordered import top_n
from chalkline.session import stored

# Cosines are compared after rounding, so that equal vectors tie whatever block they fall in.
DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """0 when the sizes differ or a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


# E1 ----------------------------------------------------------------------------


def vector_search(
    chunks: DataFrame,
    query: Sequence[float],
    limit: int = 10,
    min_score: float = 0.0,
    repo: str | None = None,
    file_type: str | None = None,
) -> DataFrame:
    """The ``limit`` chunks closest to one query vector. The query is a literal, so this is one
    scan with a top-k."""
    if not len(query):
        return chunks.withColumn("score", F.lit(None).cast("double")).limit(0)
    df = chunks.filter(F.col("embedding").isNotNull())
    if repo:
        df = df.filter(F.col("repo_key") == repo)
    if file_type:
        df = df.filter(F.col("file_path").endswith(f".{file_type}"))
    target = F.array(*[F.lit(float(x)) for x in query])
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.lit(length)
    score = F.when(
        (F.size("embedding") != len(query)) | (norm == 0), F.lit(0.0)
    ).otherwise(dot(F.col("embedding"), target) / norm)
    # the floor is applied to the best rows: a filter before the sort would compute the score twice
    best = df.withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(limit)
    return best.filter(F.col("score") >= min_score)


def upsert(store: DataFrame, changes: DataFrame, key: str = "id", at: str = "indexed_at") -> DataFrame:
    """Last write per key wins."""
    rows = store.unionByName(changes)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(at)).alias("r")).select("r.*")


def delete_chunks(store: DataFrame, repo: str, file_path: str | None = None) -> DataFrame:
    """The store without a repository, or without one of its files."""
    hit = F.col("repo_key") == repo
    if file_path is not None:
        hit = hit & (F.col("file_path") == file_path)
    return store.filter(~F.coalesce(hit, F.lit(False)))


def store_stats(store: DataFrame) -> DataFrame:
    """Chunks per repository."""
    return store.groupBy("repo_key").agg(F.count("*").alias("chunks"))


# E2, E3 ----------------------------------------------------------------------------

#: vectors of one block of the neighbours, about; the products of two such blocks are the work of one task
BLOCK = 20_000
#: vectors of one block of the profile, at most
PROFILE_BLOCK = 8192
#: vectors that place the cells; any sample gives the same result
SAMPLE = 4096
#: directions in which cells have borders
AXES = 8
#: cosines held at a time
STRIP = 1 << 21
#: tasks over which pairs of blocks are dealt, at most
MOST_TASKS = 4000


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, width, v): vectors of length 1 as the bytes of their doubles; those without length stay as they are.
    Vectors that are null, empty, or hold a null, NaN or infinite entry are left out."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            at = np.asarray(lists.offsets).astype(np.int64)
            entries = np.array(lists.values.fill_null(math.nan).to_numpy(zero_copy_only=False), np.float64)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
            width = np.diff(at)
            fine = np.asarray(lists.is_valid()) & (wrong[at[1:]] == wrong[at[:-1]]) & (width > 0)
            for w in np.unique(width[fine]).tolist():
                rows = np.flatnonzero(fine & (width == w))
                m = entries[at[rows][:, None] + np.arange(w)]
                norm = np.sqrt(np.einsum("ij,ij->i", m, m))
                m /= np.where(norm > 0, norm, 1)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), w, np.int32)), pa.array([x.tobytes() for x in m + 0.0], pa.binary())],
                    names=["id", "width", "v"],
                )

    kind = vectors.schema[id_col].dataType.simpleString()
    wide = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return wide.mapInArrow(run, f"id {kind}, width int, v binary")


def _matrix(packed, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, width)


def _cells(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, axis, cut) of a tree that halves the sample ``depth`` times, each time along the widest of its main directions."""
    _, q = np.linalg.eigh(sample.T @ sample)
    q = np.ascontiguousarray(q[:, ::-1][:, :AXES])
    axis, cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    held = {1: sample @ q}
    for node in range(1, 1 << depth):
        x = held.pop(node)
        if len(x):
            axis[node] = int(np.ptp(x, axis=0).argmax())
            cut[node] = float(np.median(x[:, axis[node]]))
        side = x[:, axis[node]] > cut[node]
        held[2 * node], held[2 * node + 1] = x[~side], x[side]
    return q, axis, cut


def _cosines(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of single pairs, taken so many at a time that their vectors stay within a strip."""
    step = max(1, STRIP // a.shape[1])
    parts = [np.einsum("ij,ij->i", a[row[i : i + step]], b[col[i : i + step]]) for i in range(0, len(row), step)]
    return np.round(np.concatenate(parts), DIGITS) + 0.0 if parts else np.zeros(0)


def _top(row: np.ndarray, value: np.ndarray, k: int, within: float) -> np.ndarray:
    """Which values are at most ``within`` below the ``k``-th best of their row; ``row`` ascends."""
    if not len(row):
        return np.zeros(0, bool)
    at = np.minimum(np.searchsorted(row, row) + k - 1, len(row) - 1)
    least = np.where(row[at] == row, value[np.lexsort((-value, row))][at], -np.inf)
    return value >= least - within


def _near(a: np.ndarray, b: np.ndarray, k: int, threshold: float, same: bool):
    """(row of a, row of b, cosine) of the up to ``k`` best of each row, ties to the earlier row of b.

    A product in single precision is within ``slack`` of the cosine (twice the usual bound of rounding). Pairs that it
    leaves above the threshold and near the row's ``k``-th best are multiplied again in double precision; strips
    that stay crowded, such as those of copies, are multiplied whole."""
    slack = (a.shape[1] + 8) * 2.0**-23
    rough_a, rough_b = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    step = max(1, STRIP // len(b))
    for i in range(0, len(a), step):
        rough = rough_a[i : i + step] @ rough_b
        mine = np.arange(len(rough))
        if same:
            rough[mine, i + mine] = -2
        hit = np.flatnonzero(rough >= threshold - slack)
        if len(hit) * 16 >= rough.size and len(b) > k:
            least = np.partition(rough, len(b) - k, axis=1)[:, len(b) - k][:, None] - 3 * slack
            hit = np.flatnonzero(rough >= np.maximum(least, threshold - slack))
        if len(hit) * 16 < rough.size:
            row, col = np.divmod(hit, len(b))
            few = _top(row, rough.ravel()[hit], k, 3 * slack)
            row, col = row[few], col[few]
            cos = _cosines(a, b, i + row, col)
            good = cos >= threshold
            row, col, cos = row[good], col[good], cos[good]
            order = np.lexsort((col, -cos, row))
            row, col, cos = row[order], col[order], cos[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield i + row[first], col[first], cos[first]
            continue
        cos = np.round(a[i : i + step] @ b.T, DIGITS) + 0.0
        if same:
            cos[mine, i + mine] = -2
        keep = cos >= threshold
        if len(b) > k:
            least = np.partition(cos, len(b) - k, axis=1)[:, len(b) - k][:, None]
            above, ties = keep & (cos > least), keep & (cos == least)
            keep = above | ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True))
        row, col = np.nonzero(keep)
        yield i + row, col, cos[row, col]


def block_routes(unit: DataFrame, count: int, width: int, threshold: float, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, routes): ``unit`` with its ``block``, and (block, low, high) for the pairs of blocks that have to meet.

    A tree over the main directions of a sample deals the vectors into about four cells, more if a block would
    exceed ``BLOCK``; cells of more than two blocks, such as copies of one vector, are dealt on by a hash. Two cells whose
    boxes lie further apart than vectors at the threshold can, do not meet. The driver sees the sample and a box a
    cell."""
    size = block or min(BLOCK, max(1024, -(-count // 4)))
    depth = max(0, math.ceil(math.log2(count / size)))
    sample = unit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    q, axis, cut = _cells(_matrix([r["v"] for r in sample], width), depth)
    kind = unit.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v").to_pylist(), width) @ q
            node = np.ones(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + (x[np.arange(len(x)), axis[node]] > cut[node])
            box = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array((node - (1 << depth)).astype(np.int32)), box], names=["id", "v", "cell", "x"])

    celled = stored(unit.mapInArrow(place, f"id {kind}, v binary, cell int, x array<double>"))
    axes = q.shape[1]
    edges = [f(F.col("x")[d]).alias(f"{name}{d}") for d in range(axes) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = celled.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").toPandas()
    parts = np.ceil(boxes["n"].to_numpy() / (2 * size)).astype(int)
    first = np.concatenate([[0], np.cumsum(parts)])
    low, high = (boxes[[f"{name}{d}" for d in range(axes)]].to_numpy() for name in ("lo", "hi"))
    found = []
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
        for j in (i + np.flatnonzero((gap**2).sum(axis=1) <= 2 - 2 * threshold + 1e-9)).tolist():
            mine, theirs = np.arange(first[i], first[i + 1]), np.arange(first[j], first[j + 1])
            found += [(x, y) for x in mine.tolist() for y in theirs.tolist() if x <= y]
    routes = pd.DataFrame([(b, x, y) for x, y in found for b in {x, y}], columns=["block", "low", "high"], dtype="int64")
    spark = unit.sparkSession
    where = pd.DataFrame({"cell": boxes["cell"], "first": first[:-1], "parts": parts}).astype("int64")
    lane = F.pmod(F.xxhash64("id"), F.col("parts"))
    placed = celled.join(spark.createDataFrame(where), "cell").select("id", "v", (F.col("first") + lane).alias("block"))
    return placed, spark.createDataFrame(routes)


def _best(width: int, k: int, threshold: float):
    """What the task of a pair of blocks, or of a block with itself, does."""

    def best(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("block")
        ids = [np.asarray(x) for x in pair["ids"]]
        vs = [_matrix(x, width) for x in pair["vs"]]
        found = [(ids[0], ids[-1], *x) for x in _near(vs[0], vs[-1], k, threshold, len(vs) == 1)]
        if len(vs) == 2:
            found += [(ids[1], ids[0], *x) for x in _near(vs[1], vs[0], k, threshold, False)]
        parts = [pd.DataFrame({"id": a[r], "other": b[c], "cosine": v}) for a, b, r, c, v in found if len(r)]
        return pd.concat(parts) if parts else pd.DataFrame({"id": [], "other": [], "cosine": []})

    return best


def neighbours(
    vectors: DataFrame, k: int, threshold: float, id_col: str = "id", vector_col: str = "embedding", block: int | None = None
) -> DataFrame:
    """The up to ``k`` nearest others of each vector with cosine at least ``threshold`` (ties by id),
    as (id, other, cosine, rank). Exact, copies included. Vectors of different sizes are no neighbours.

    Vectors meet as blocks: one row a block holds its ids and the bytes of its vectors, and goes to each pair of blocks
    it is part of (``block_routes``). Pairs of blocks are multiplied one by one in strips (``_near``), so a task
    holds two blocks and a strip, and returns at most ``k`` rows for each vector of either."""
    unit = stored(unit_rows(vectors, id_col, vector_col))
    kind = unit.schema["id"].dataType.simpleString()
    out = f"id {kind}, other {kind}, cosine double"
    near = vectors.sparkSession.createDataFrame([], out)
    for group in unit.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect():
        width = group["width"]
        placed, routes = block_routes(unit.filter(F.col("width") == width), group["n"], width, threshold, block)
        packed = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("s"))
        sent = packed.select("block", F.col("s.id").alias("ids"), F.col("s.v").alias("vs")).join(routes, "block")
        # a pair of blocks is a task's worth of work; with several tasks for each, few get two
        sent = sent.repartition(min(MOST_TASKS, 2 * routes.count()), "low", "high")
        near = near.unionByName(sent.groupBy("low", "high").applyInPandas(_best(width, k, threshold), out))
    return top_n(near, ["id"], [F.col("cosine").desc(), F.col("other").asc()], k)


def mutual_knn(vectors: DataFrame, k: int = 15, threshold: float = 0.86, **options) -> DataFrame:
    """Pairs (a, b, cosine), a < b, where each is among the other's ``k`` nearest and the cosine
    reaches the threshold."""
    near = neighbours(vectors, k, threshold, **options).drop("rank")
    pair = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cosine")
    return pair.groupBy("a", "b").agg(F.count("*").alias("_n"), F.max("cosine").alias("cosine")).filter("_n = 2").drop("_n")


def reciprocal_best(vectors: DataFrame, threshold: float = 0.92, scripts: DataFrame | None = None, **options) -> DataFrame:
    """Pairs that are each other's nearest with cosine at least the threshold; with
    ``scripts(id, script)`` also whether they cross scripts."""
    pairs = mutual_knn(vectors, 1, threshold, **options)
    if scripts is None:
        return pairs
    of = lambda side: scripts.select(F.col("id").alias(side), F.col("script").alias(f"_{side}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.withColumn("cross_script", F.col("_a") != F.col("_b")).drop("_a", "_b")


# E4 ------------------------------------------------------------------------------------


def cosine_profile(
    vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", blocks: int | None = None, digits: int = 6
) -> DataFrame:
    """Min, median, p95 and max cosine over all pairs, to ``digits`` decimals; 0 for vectors of different sizes.

    Equal vectors are merged with their number, so copies cost nothing. The rest is packed, one row a block, and
    compared block by block, so the shuffle has a row for each pair of blocks. The product runs twice: first tasks return
    counts per thousandth, then counts per value of the few thousandths that hold a wanted rank; what the
    driver adds up is bounded by the number of decimals. By default there are four blocks, more if
    one would exceed ``PROFILE_BLOCK``."""
    count = blocks or max(4, -(-vectors.count() // PROFILE_BLOCK))
    merged = unit_rows(vectors, id_col, vector_col).groupBy("width", "v").agg(F.count("*").alias("times"))
    packed = stored(
        merged.groupBy("width", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(count)).cast("int").alias("mine"))
        .agg(F.sort_array(F.collect_list(F.struct("v", "times"))).alias("s"), F.sum("times").alias("n"))
        .select("width", "mine", F.col("s.v").alias("vs"), F.col("s.times").alias("times"), "n")
    )
    sizes = [r["n"] for r in packed.groupBy("width").agg(F.sum("n").alias("n")).collect()]
    pairs = sum(sizes) * (sum(sizes) - 1) // 2
    apart = pairs - sum(n * (n - 1) // 2 for n in sizes)
    schema = "pairs bigint, min double, median double, p95 double, max double"
    if not pairs:
        return vectors.sparkSession.createDataFrame([(None,) * 5], schema)
    spread = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other")).drop("n")
    met = spread.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).groupBy("width", "low", "high")
    scale, step = 10**digits, max(1, 10**digits // 1000)

    def tally(wanted: list[int] | None) -> list[tuple[int, int]]:
        found = met.applyInPandas(_pair_counts(scale, step, wanted), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
        told = {r["at"]: r["n"] for r in found.collect()}
        if apart and (wanted is None or 0 in wanted):
            told[0] = told.get(0, 0) + apart
        return sorted(told.items())

    places = [0.0, 0.5 * (pairs - 1), 0.95 * (pairs - 1), float(pairs - 1)]
    ranks = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    coarse = tally(None)
    ends = np.cumsum([n for _, n in coarse])
    holds = {r: int(np.searchsorted(ends, r, "right")) for r in ranks}
    exact = tally(sorted({coarse[h][0] for h in holds.values()}))
    value = {}
    for r, h in holds.items():
        inside = [(at, n) for at, n in exact if at // step == coarse[h][0]]
        upto = int(ends[h]) - coarse[h][1] + np.cumsum([n for _, n in inside])
        value[r] = inside[int(np.searchsorted(upto, r, "right"))][0] / scale
    cut = [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for x in places]
    return vectors.sparkSession.createDataFrame([(pairs, *cut)], schema)


def _pair_counts(scale: int, step: int, wanted: list[int] | None):
    """Counts of the cosines of a pair of blocks, in units of ``step`` / ``scale``, or in single units inside the wanted ones."""

    def counts(pair: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pair["low"].iloc[0]), int(pair["high"].iloc[0])
        pair = pair.sort_values("mine")
        if low != high and len(pair) < 2:
            return pd.DataFrame({"at": [], "n": []})
        vs = [_matrix(x, int(pair["width"].iloc[0])) for x in pair["vs"]]
        times = [np.asarray(x, np.int64) for x in pair["times"]]
        far = scale // step + 2
        total: dict[int, int] = {}
        rows = max(1, STRIP // len(vs[-1]))
        for i in range(0, len(vs[0]), rows):
            at = np.rint((vs[0][i : i + rows] @ vs[-1].T) * scale).astype(np.int64)
            n = np.outer(times[0][i : i + rows], times[-1])
            if low == high:  # each two once, and the copies of one with each other
                mine = np.arange(len(at))
                n[mine, i + mine] = times[0][i + mine] * (times[0][i + mine] - 1) // 2
                n[np.arange(n.shape[1])[None, :] < (i + mine)[:, None]] = 0
            unit = at // step
            if wanted is None:
                some = n > 0
                sums = np.zeros(2 * far + 1, np.int64)
                np.add.at(sums, unit[some] + far, n[some])
                for u in np.flatnonzero(sums).tolist():
                    total[u - far] = total.get(u - far, 0) + int(sums[u])
            else:
                some = np.isin(unit, wanted) & (n > 0)
                values, place = np.unique(at[some], return_inverse=True)
                sums = np.zeros(len(values), np.int64)
                np.add.at(sums, place, n[some])
                for v, m in zip(values.tolist(), sums.tolist()):
                    total[v] = total.get(v, 0) + m
        return pd.DataFrame({"at": list(total), "n": list(total.values())}, dtype="int64")

    return counts


# X1 ---------------------------------------------------------------------------------------

# Weights of the fields of a text index, A to D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def weighted_index(catalog: DataFrame, fields: dict[str, str], key: str = "id") -> DataFrame:
    """(key, token, weight) rows: per field (``{"grade": "A", ...}``) its distinct lower-case words."""
    cells = [
        F.struct(
            F.lit(WEIGHTS[letter]).alias("weight"),
            F.array_distinct(
                F.filter(F.split(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
            ).alias("tokens"),
        )
        for name, letter in fields.items()
    ]
    wide = catalog.select(key, F.inline(F.array(*cells)))
    return wide.select(key, "weight", F.explode("tokens").alias("token"))


def weighted_search(index: DataFrame, query: str, key: str = "id", limit: int = 20) -> DataFrame:
    """Rows by the sum of the weights of matching words."""
    words = sorted({w for w in "".join(c if c.isalnum() or c == "_" else " " for c in query.lower()).split()})
    hits = index.filter(F.col("token").isin(words))
    return (
        hits.groupBy(key)
        .agg(F.round(F.sum("weight"), 6).alias("score"), F.count_distinct("token").alias("words"))
        .orderBy(F.col("score").desc(), key)
        .limit(limit)
    )
