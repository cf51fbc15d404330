"""Embedding whitening: a distributed centred covariance, its leading eigenpairs by bisection, a shipped projection."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.session import cut_lineage

#: entries are rounded down to 1 / 64 and moved by this
SCALE, SHIFT = 64, 1_000_000
_KINDS = {2: np.int16, 4: np.int32, 8: np.int64}
_FAR = 2**52


class Whitening(NamedTuple):
    """What the projection needs: its size follows the width of the vectors, not their number."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


# vectors to whole numbers ---------------------------------------------------------------------


def _valid(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first entry, entries as double): the rows whose vector has no null and no infinite entry."""
    lists = batch.column(column)
    at = np.asarray(lists.offsets).astype(np.int64)
    entries = lists.values
    ok = np.array(entries.is_valid())
    numbers = entries.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64, copy=True)
    ok &= np.isfinite(numbers)
    numbers[~ok] = 0
    bad = np.concatenate([[0], np.cumsum(~ok)])
    row = np.flatnonzero(np.asarray(lists.is_valid()) & (bad[at[1:]] == bad[at[:-1]]))
    return row, at, numbers


def whole(numbers: np.ndarray) -> np.ndarray:
    """floor(64 c) as long, without the shift; entries beyond 2 ** 52 / 64 count as that."""
    return np.clip(np.floor(SCALE * numbers), -_FAR, _FAR).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """A vector in the fewest bytes an entry that hold it, so equal vectors are equal bytes."""
    top = int(np.abs(x).max(initial=0))
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([size]) + x.astype(_KINDS[size]).tobytes()


def _unpack(data: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(data), width), np.int64)
    for i, b in enumerate(data):
        out[i] = np.frombuffer(b, _KINDS[b[0]], offset=1)
    return out


def _packed(vectors: DataFrame, vector: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            row, at, numbers = _valid(batch, "v")
            x = whole(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_pack(x[at[r] : at[r + 1]]) for r in row.tolist()], pa.binary()), pa.array(np.diff(at)[row], pa.int32())],
                names=["x", "width"],
            )

    return vectors.select(F.col(vector).alias("v")).mapInArrow(run, "x binary, width int")


# sums over the fit list -------------------------------------------------------------------


def _sum_rows(parts: DataFrame) -> dict[int, np.ndarray]:
    """Add vectors (i, part, data) per i, in the order of the parts, so a rerun gives the same bits.

    Each task streams its sorted rows; the driver gets one vector per i, and i runs over dimensions.
    """

    def run(batches):
        i, total, out = None, None, []
        for batch in batches:
            for j, data in zip(batch.column("i").to_pylist(), batch.column("data").to_pylist()):
                v = np.frombuffer(data, np.float64)
                if j == i:
                    total = total + v
                else:
                    if i is not None:
                        out.append((i, total.tobytes()))
                    i, total = j, v
        if i is not None:
            out.append((i, total.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["i", "data"])

    summed = parts.repartition("i").sortWithinPartitions("i", "part").select("i", "data").mapInArrow(run, "i int, data binary")
    return {r["i"]: np.frombuffer(r["data"], np.float64) for r in summed.collect()}


def _products(fit: DataFrame, width: int, mean: np.ndarray, project: np.ndarray | None = None, shift: np.ndarray | None = None):
    """(sum of rows, sum of their outer products) of the centred fit list, or of its projection less ``shift``."""

    def run(batches):
        from pyspark import TaskContext

        total, outer = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                y = _unpack(batch.column("x").slice(i, 1024).to_pylist(), width) - mean
                y = y if project is None else y @ project
                y = y if shift is None else y - shift
                if total is None:
                    total, outer = np.zeros(y.shape[1]), np.zeros((y.shape[1], y.shape[1]))
                total += y.sum(axis=0)
                outer += y.T @ y
        if total is not None:
            part, k = TaskContext.get().partitionId(), len(total)
            data = [total.tobytes()] + [outer[i].tobytes() for i in range(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k + 1), pa.int32()), pa.array([part] * (k + 1), pa.int32()), pa.array(data, pa.binary())], names=["i", "part", "data"]
            )

    got = _sum_rows(fit.select("x").mapInArrow(run, "i int, part int, data binary"))
    return got[0], np.stack([got[i + 1] for i in range(len(got) - 1)])


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension; halves of the entries are added apart, so nothing overflows."""

    def run(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                x = _unpack(batch.column("x").slice(i, 1024).to_pylist(), width)
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    got = fit.select("x").mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("i").collect()
    return got[0]["n"], [(r["high"] << 32) + r["low"] for r in got]


# eigenpairs of a symmetric matrix ----------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): Householder reflections that make ``a`` tridiagonal."""
    a, n = a.copy(), len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = math.sqrt(float(x @ x))
        v = x
        if size:
            v[0] += math.copysign(size, v[0])
            v /= math.sqrt(float(v @ v))
            b = a[k + 1 :, k + 1 :]
            p = b @ v
            w = 2 * (p - (v @ p) * v)
            b -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = -math.copysign(size, x[0])
        reflectors.append(v)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(n - 1)]), reflectors


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value: negative terms of its Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = d[0] - at
    count = (q < 0).astype(np.int64)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[k] - at - e[k - 1] ** 2 / q
        count += q < 0
    return count


def largest(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected until its interval cannot be halved."""
    n = len(d)
    rim = np.zeros(n)
    rim[:-1] += np.abs(e)
    rim[1:] += np.abs(e)
    low, high = np.full(count, (d - rim).min()), np.full(count, (d + rim).max())
    pad = 1e-15 * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    wanted = n - 1 - np.arange(count)  # the k-th largest has that many below it
    for _ in range(200):
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        right = below(d, e, mid) > wanted
        high, low = np.where(right, mid, high), np.where(right, low, mid)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, b: np.ndarray, small: float) -> np.ndarray:
    """Solve a tridiagonal system by elimination with row exchanges; a zero pivot counts as ``small``."""
    n = len(d)
    main, up, up2 = d.copy(), np.append(e, 0.0), np.zeros(n)
    low, x = e.copy(), b.copy()
    for k in range(n - 1):
        if abs(low[k]) > abs(main[k]):
            main[k], low[k] = low[k], main[k]
            up[k], main[k + 1] = main[k + 1], up[k]
            if k < n - 2:
                up2[k], up[k + 1] = up[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        pivot = main[k] if main[k] else small
        f = low[k] / pivot
        main[k] = pivot
        main[k + 1] -= f * up[k]
        if k < n - 2:
            up[k + 1] -= f * up2[k]
        x[k + 1] -= f * x[k]
    main[n - 1] = main[n - 1] or small
    for k in range(n - 1, -1, -1):
        rest = x[k]
        if k < n - 1:
            rest -= up[k] * x[k + 1]
        if k < n - 2:
            rest -= up2[k] * x[k + 2]
        x[k] = rest / main[k]
    return x


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Vectors come by inverse iteration; those whose values lie close together (a thousandth of the norm) are
    made orthogonal to each other in every step.
    """
    n = len(a)
    count = min(count, n)
    d, e, reflectors = tridiagonal(a)
    values = largest(d, e, count)
    norm = max(float(np.abs(d).max()), float(np.abs(e).max(initial=0.0)))
    small = np.finfo(float).eps * norm or np.finfo(float).tiny
    rng = np.random.default_rng(5)
    vectors = np.zeros((n, count))
    first = 0
    for k in range(count):
        if k and values[k - 1] - values[k] > 1e-3 * norm:
            first = k
        x = rng.standard_normal(n)
        for _ in range(6):
            x /= math.sqrt(float(x @ x))
            # the same value twice would give the same system: move it by a few units in the last place
            x = _solve(d - (values[k] - (k - first) * 4 * small), e, x, small)
            for _ in range(2):
                near = vectors[:, first:k]
                x -= near @ (near.T @ x)
        vectors[:, k] = x / math.sqrt(float(x @ x))
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return values, vectors


# the operator -----------------------------------------------------------------------------


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """Mean, leading components and figures of the distinct vectors; None if there is no valid vector with an entry."""
    distinct = cut_lineage(_packed(vectors, vector).where("width > 0").distinct())
    widths = distinct.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths:
        return None
    width = widths[0]["width"]
    distinct = distinct.where(F.col("width") == width)
    n, sums = _sums(distinct, width)
    mean = np.array([s / n for s in sums])  # whole numbers by whole numbers: correctly rounded
    left, outer = _products(distinct, width, mean)
    left = left / n
    covariance = outer / n - np.outer(left, left)
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, basis = leading(covariance, components) if trace > 0 else (np.zeros(0), np.zeros((width, 0)))
    real = values > 1e-12 * trace
    values, basis = values[real], basis[:, real]
    error = 0.0
    if len(values):
        scaled = basis / np.sqrt(values)
        rest, square = _products(distinct, width, mean, scaled, left @ scaled)
        rest = rest / n
        error = float(np.abs(square / n - np.outer(rest, rest) - np.eye(len(values))).max())
    return Whitening(n, tuple(s + n * SHIFT for s in sums), values, basis, trace, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) ** 2 for each row, exact; None where it passes 63 bits."""
    about = ((n * x.astype(np.float64) - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    low = np.array([s & (2**64 - 1) for s in sums], np.uint64).view(np.int64)
    with np.errstate(over="ignore"):
        y = x * np.int64(n) - low  # modulo 2 ** 64, which is exact where the sum fits
        exact = (y * y).sum(axis=1).tolist()
    out: list[int | None] = exact
    for i in np.flatnonzero(about > 2.0**62).tolist():
        true = sum((n * int(c) - s) ** 2 for c, s in zip(x[i].tolist(), sums))
        out[i] = true if true < 2**63 else None
    return out


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row per vector and leading component: id, component, n, deviation, whitened, explained, identity_error.

    Entries c become whole numbers x = floor(64 c) + 1 000 000. The fit list holds each distinct x vector once.

    1. Tasks pack the vectors; equal ones are merged before and after one shuffle, so copies cost nothing.
    2. Exact sums, then the sum of outer products of x less its mean: each task adds up one matrix, and its rows are
       added per dimension in a fixed order. The driver holds one width x width matrix, whatever the rows.
    3. Householder reflections, bisection by Sturm counts and inverse iteration give the leading eigenpairs.
    4. Mean and components ride along with the tasks that scan the vectors again; rows are not shuffled.

    Vectors that are null, or hold a null, NaN or infinite entry, give no row. The width is the most common one
    among the distinct vectors (the larger of two); vectors of another width, empty ones too, cannot
    be projected and give no row. Components whose eigenvalue is 0 (below 1e-12 of the trace), as with fewer
    distinct vectors than components, do not exist: a single vector or an empty table gives no
    row. Null ids stay; repeated rows give rows of their own; other columns are not looked at. Entries
    beyond 2 ** 46 count as 2 ** 46. ``deviation`` is null where it passes 63 bits.
    """
    model = fit(vectors, vector, components)
    kind = vectors.schema[id].dataType.simpleString()
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame(
            [], f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    n, width = model.n, len(model.sums)
    sums = [s - n * SHIFT for s in model.sums]
    mean, scaled = np.array([s / n for s in sums]), model.vectors / np.sqrt(model.values)

    def run(batches):
        for batch in batches:
            row, at, numbers = _valid(batch, "v")
            row = row[np.diff(at)[row] == width]
            x = whole(numbers[at[row][:, None] + np.arange(width)])
            flat = ((x - mean) @ scaled).ravel()
            offsets = pa.array(np.arange(len(row) + 1) * scaled.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["id", "deviation", "w"],
            )

    projected = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"id {kind}, deviation long, w array<double>")
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return projected.select(F.col("id").alias(id), "deviation", F.posexplode("w").alias("at", "whitened")).select(
        id,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
