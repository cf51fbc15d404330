"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.words import column_bytes, slices

#: what the texts are reduced to: lower-case letters, all other ASCII characters are one kind of border
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
SUBWORDS = (3, 4)


def subwords(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all runs of 3 and 4 bytes inside a row; none starts with two borders."""
    buf, at = column_bytes(column)
    b = _LETTER[buf].astype(np.uint32)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    buckets, rows = [], []
    for n in SUBWORDS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        code = b[:m].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | b[k : k + m]
        keep = (row[:m] == row[n - 1 :]) & ~((b[:m] == 32) & (b[1 : m + 1] == 32))
        code = code[keep] ^ np.uint32(0x5BD1E995 * n & 0xFFFFFFFF)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
        code ^= code >> np.uint32(13)
        code *= np.uint32(3266489917)
        buckets.append(code >> np.uint32(32 - bits))
        rows.append(row[:m][keep])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


@dataclass
class Model:
    """logits = mean of ``scores[bucket]`` + ``bias``; the rows of ``scores`` are embeddings times softmax weights."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int

    def logits(self, column: pa.Array) -> np.ndarray:
        bucket, row = subwords(column, self.bits)
        n = len(column)
        size = np.maximum(np.bincount(row, minlength=n), 1)[:, None]
        picked = self.scores[bucket]
        sums = np.stack([np.bincount(row, picked[:, k], n) for k in range(len(self.languages))], 1)
        return sums / size + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(
    rows: list[tuple[str, np.ndarray, np.ndarray, bool]],
    bits: int = 16,
    dim: int = 16,
    epochs: int = 8,
    rate: float = 4.0,
    precision: float = 0.99,
    seed: int = 1,
) -> Model:
    """Stochastic gradient descent on (language, buckets, counts, calibrate) rows.

    Rows marked ``calibrate`` are not learned: they set the temperature of the softmax (least log
    loss) and the smallest score from which answers are right in ``precision`` of the cases.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    weight, bias = np.zeros((dim, k)), np.zeros(k)
    learn = [(place[x], ids, counts / counts.sum()) for x, ids, counts, later in rows if not later and len(ids)]
    held = [(place[x], ids, counts / counts.sum()) for x, ids, counts, later in rows if later and len(ids)]
    share = np.bincount([y for y, _, _ in learn], minlength=k).astype(float)
    balance = share.sum() / np.maximum(share, 1) / k
    total, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for j in rng.permutation(len(learn)):
            y, ids, w = learn[j]
            step = rate * (1 - done / total)
            h = w @ embed[ids]
            g = softmax(h @ weight + bias)
            g[y] -= 1
            g *= min(1.0, balance[y])
            back = weight @ g
            weight -= step * np.outer(h, g)
            bias -= 0.05 * step * g
            embed[ids] -= step * len(ids) ** 0.5 * w[:, None] * back
            done += 1
    scores = (embed @ weight).astype(np.float32)
    temperature, threshold = 1.0, 0.0
    if held:
        z = np.array([w @ scores[ids] + bias for _, ids, w in held])
        y = np.array([y for y, _, _ in held])
        grid = np.exp(np.linspace(-4, 4, 81))
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / temperature)
        best, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision)
        threshold = float(best[order[good[-1]]]) if len(good) else 1.0
    return Model(languages, scores, bias, temperature, threshold, bits)


def _letters(text: str):
    """The text with a border at both ends; the same for learning and for answering."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))


def train(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, bits: int = 16, **settings
) -> Model | None:
    """Fit on at most ``per_language`` documents of each language, drawn by a hash of the id.

    The bound holds what is gathered at the driver: per document the buckets of its whole text and
    of one short stretch (so that short texts are known too), at most ``2 ** bits`` of them each.
    A fifth of the documents calibrates. Rows without language, id or letters are not learned
    from; without any row to learn from there is no model.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & F.col(text).rlike(r"\p{L}"))
    draw = Window.partitionBy("lang").orderBy("h", "id")
    # a share of each language that holds half as many again as wanted, so that few rows meet in one task
    chosen_share = 1.5 * per_language / F.col("n")
    counts = usable.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    ids = (
        usable.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(F.col(id), F.lit(7)).alias("h"))
        .join(counts, "lang")
        .where(F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.lit(1 << 20)) < chosen_share * (1 << 20))
        .withColumn("r", F.row_number().over(draw))
        .where(F.col("r") <= per_language)
        .select("id", "lang", F.pmod(F.col("h"), F.lit(5)).alias("fold"))
        .distinct()
    )
    texts = docs.select(F.col(id).alias("id"), F.col(lang).alias("lang"), _letters(text).alias("text"))
    chosen = texts.join(F.broadcast(ids), ["id", "lang"])  # at most per_language rows a language
    chosen = chosen.groupBy("id", "lang", "fold").agg(F.min("text").alias("text"))  # one row of a repeated id

    def counted(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = []
                for lang, text, fold in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "fold"))):
                    words = text.split()
                    at = int(np.random.default_rng(len(text)).integers(0, max(1, len(words) - 8)))
                    for t in (text, " " + " ".join(words[at : at + 8]) + " "):
                        ids, counts = np.unique(subwords(pa.array([t]), bits)[0], return_counts=True)
                        out.append((lang, ids.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), fold == 0))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["lang", "ids", "counts", "later"])

    rows = chosen.mapInArrow(counted, "lang string, ids binary, counts binary, later boolean").collect()
    rows = sorted((r.lang, bytes(r.ids), bytes(r.counts), r.later) for r in rows)
    rows = [(x, np.frombuffer(i, "<i4"), np.frombuffer(c, "<i4"), later) for x, i, c, later in rows]
    return fit(rows, bits=bits, **settings) if any(not r[3] for r in rows) else None


def identify(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for every row, from its whole text alone.

    ``score`` is the calibrated probability of the answer; ``rejected`` says that it lies below the
    calibrated threshold. Texts that are null or have no letter are ``und`` with score 0 and
    rejected, and so is every text when there is no model.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has"), _letters(text).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits x languages numbers, however many rows there are

    def answer(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                p = softmax(m.logits(part.column("text")) / m.temperature)
                has = part.column("has").to_numpy(zero_copy_only=False)
                score = np.where(has, p.max(1), 0.0)
                lang = np.where(has, names[p.argmax(1)], "und")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array((score < m.threshold) | ~has)],
                    names=["id", "lang_pred", "score", "rejected"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(answer, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id)


def fifth(id: str):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(5))
