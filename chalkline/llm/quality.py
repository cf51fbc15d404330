"""Text quality: an interpolated modified Kneser-Ney model of trusted text, and perplexity limits by language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm import blocks
from chalkline.llm.repeats import _by
from chalkline.llm.words import column_bytes, slices
from chalkline.session import cut_lineage

#: the model predicts bytes and the end of a text, from a padded start; NUL in a text counts as 1
SYMBOLS = 256
NULL_ID = 2**63 - 1
#: costs are summed by cells of so many tokens; a stretch is so many neighbouring cells
CELL, STRETCH = 32, 4
#: repeats are looked for in pieces of at most this many tokens, of equal length in a text
PIECE = 256


def grams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, row): for every byte and every end of a text the ``order`` bytes up to it, the last one lowest."""
    buf, at = column_bytes(column)
    size, n = np.diff(at), len(column)
    base = at[:-1] + np.arange(n) * order  # order - 1 bytes of padding before, one after
    text = np.zeros(len(buf) + n * order, np.uint64)
    text[np.arange(len(buf)) + np.repeat(np.arange(n) * order + order - 1, size)] = np.maximum(buf, 1)
    code = text[: len(text) - order + 1].copy() if len(text) else text
    for k in range(1, order):
        code <<= np.uint64(8)
        code |= text[k : k + len(code)]
    row = np.repeat(np.arange(n), size + 1)
    return code[np.repeat(base, size + 1) + np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)], row


def worst_stretch(row: np.ndarray, logp: np.ndarray, n: int) -> np.ndarray:
    """Of each row the largest mean of -logp in a stretch of neighbouring cells; of a short row its mean."""
    count = np.bincount(row, minlength=n)
    cells = -(-count // CELL)
    cell_row = np.repeat(np.arange(n), cells)
    offset = np.arange(len(cell_row)) - np.repeat(np.cumsum(cells) - cells, cells)
    start = (np.cumsum(count) - count)[cell_row] + offset * CELL
    sums = np.r_[0.0, np.cumsum(np.add.reduceat(logp, start, dtype=float))] if len(start) else np.zeros(1)
    whole = np.flatnonzero((offset <= cells[cell_row] - STRETCH) | (offset == 0))
    wide = np.minimum(cells[cell_row[whole]], STRETCH)
    tokens = np.minimum(offset[whole] * CELL + wide * CELL, count[cell_row[whole]]) - offset[whole] * CELL
    mean = (sums[whole] - sums[whole + wide]) / tokens
    worst = np.zeros(n)
    np.maximum.at(worst, cell_row[whole], mean)
    return worst


def least_fresh(row: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Of each row the smallest share of different n-grams in a piece of it: runs that repeat themselves have few."""
    count = np.bincount(row, minlength=n)
    pieces = -(-count // PIECE)
    offset = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    piece = (np.cumsum(pieces) - pieces)[row] + offset * pieces[row] // count[row]
    total = int(pieces.sum())
    tag = np.sort((piece.astype(np.uint64) << np.uint64(40)) | g)
    new = np.ones(len(tag), bool)
    new[1:] = tag[1:] != tag[:-1]
    share = np.bincount((tag[new] >> np.uint64(40)).astype(np.int64), minlength=total) / np.bincount(piece, minlength=total)
    least = np.ones(n)
    np.minimum.at(least, np.repeat(np.arange(n), pieces), share)
    return least


def _low(g: Column, n: int) -> Column:
    return g.bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; fixed ones where a count is missing."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def fit(counts: DataFrame, order: int) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """Probability tables (g, p) of the n-grams seen, and back-off tables (ctx, gamma) of the contexts seen.

    ``counts``: (g, raw) of the highest order, a row each. Lower orders count the different bytes to
    the left of an n-gram, but for those that begin in the padding, which keep their own counts.
    Each order is a few aggregations and joins over n-grams, sharded by n-gram or context.
    """
    tables = {order: blocks.cut(counts.select("g", "raw", F.col("raw").alias("a")))}
    for n in range(order - 1, 0, -1):
        up = tables[n + 1].select(_low(F.col("g"), n).alias("g"), "raw")
        t = up.groupBy("g").agg(F.sum("raw").alias("raw"), F.count("*").alias("left"))
        padded = F.shiftright("g", 8 * (n - 1)) == 0
        tables[n] = blocks.cut(t.select("g", "raw", F.when(padded, F.col("raw")).otherwise(F.col("left")).alias("a")))
    seen: dict[int, DataFrame] = {}
    gammas: dict[int, DataFrame] = {}
    for n in range(1, order + 1):
        a = F.col("a")
        stats = tables[n].agg(*[F.sum((a == k).cast("long")) for k in range(1, 5)]).first()
        d1, d2, d3 = discounts(*[int(x or 0) for x in stats])
        off = F.when(a == 1, d1).when(a == 2, d2).otherwise(d3)
        t = tables[n].withColumn("ctx", F.shiftright("g", 8))
        sums = t.groupBy("ctx").agg(F.sum("a").alias("all"), F.sum(off).alias("off"))
        sums = blocks.cut(sums.select("ctx", "all", (F.col("off") / F.col("all")).alias("gamma")))
        gammas[n] = sums.select("ctx", "gamma")
        t = t.join(sums, "ctx").select("g", ((a - off) / F.col("all")).alias("own"), "gamma")
        if n == 1:
            seen[n] = blocks.cut(t.select("g", (F.col("own") + F.col("gamma") / (SYMBOLS + 1)).alias("p")))
        else:
            lower = seen[n - 1].select(F.col("g").alias("suffix"), F.col("p").alias("below"))
            t = t.withColumn("suffix", _low(F.col("g"), n - 1)).join(lower, "suffix")
            seen[n] = blocks.cut(t.select("g", (F.col("own") + F.col("gamma") * F.col("below")).alias("p")))
    return seen, gammas


def log_probabilities(asked: DataFrame, seen: dict[int, DataFrame], gammas: dict[int, DataFrame], order: int) -> DataFrame:
    """(g, logp) of the n-grams asked for (one row each), backing off from order to order by joins."""
    q = asked.select("g", F.col("g").alias("cur"), F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("p"))
    for n in range(order, 0, -1):
        table = seen[n].select(F.col("g").alias("cur"), F.col("p").alias("found"))
        q = q.join(table, "cur", "left").withColumn("p", F.coalesce("p", F.col("weight") * F.col("found"))).drop("found")
        q = q.withColumn("ctx", F.shiftright("cur", 8)).join(gammas[n], "ctx", "left")
        q = q.select("g", _low(F.col("cur"), n - 1).alias("cur"), (F.col("weight") * F.coalesce("gamma", F.lit(1.0))).alias("weight"), "p")
    return q.select("g", F.log(F.coalesce("p", F.col("weight") / (SYMBOLS + 1))).alias("logp"))


def _rows(columns: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


class Scorer:
    """A model of the trusted rows of one stored table, ready to score that table split by split."""

    def __init__(self, docs: DataFrame, trusted: DataFrame, id: str, text: str, order: int, held_out: int):
        if not 1 <= order <= 5:
            raise ValueError("an n-gram and the number of its piece share 64 bits: order must be 1 to 5")
        self.docs, self.id, self.text, self.order = docs, id, text, order
        spark = docs.sparkSession
        self.folder, self.count = blocks.shared_folder(spark, "quality"), blocks.shards(spark)
        self._mark(trusted, held_out)
        rows = self._texts()
        folder, count = self.folder, self.count

        def learn(batches):
            side, held, size, seen_rows = Scorer._side(folder), [], 0, (0, 0)

            def flush():
                g, n = np.unique(np.concatenate(held), return_counts=True)
                return _rows([g.astype(np.int64), n], ["g", "raw"], [pa.int64(), pa.int64()])

            for ids, texts in Scorer._slices(batches):
                seen_rows = blocks.checksum(ids, seen_rows)
                chosen = np.flatnonzero(Scorer._has(side, ids, 0))
                if len(chosen):
                    held.append(grams(texts.take(pa.array(chosen)), order)[0])
                    size += len(held[-1])
                    if size > 8 << 20:
                        yield flush()
                        held, size = [], 0
            Scorer._same(side, seen_rows)
            if size:
                yield flush()

        counts = rows.mapInArrow(learn, "g long, raw long").groupBy("g").agg(F.sum("raw").alias("raw"))
        seen, gammas = fit(counts, order)

        def ask(batches):
            from pyspark import TaskContext

            block, known, fresh, size, seen_rows = TaskContext.get().partitionId(), np.zeros(0, np.uint64), [], 0, (0, 0)
            for ids, texts in Scorer._slices(batches):
                seen_rows = blocks.checksum(ids, seen_rows)
                fresh.append(np.unique(grams(texts, order)[0]))
                size += len(fresh[-1])
                if size > 4 << 20:
                    known, fresh, size = np.unique(np.concatenate([known, *fresh])), [], 0
            Scorer._same(Scorer._side(folder), seen_rows)
            known = np.unique(np.concatenate([known, *fresh]))
            out = [(s, block, g.astype("<i8").tobytes()) for s, g in _by((known % np.uint64(count)).astype(np.int64), known)]
            if out:
                yield _rows(list(zip(*out)), ["shard", "block", "keys"], [pa.int32(), pa.int32(), pa.binary()])

        asked = blocks.cut(rows.mapInArrow(ask, "shard int, block int, keys binary").repartition(count, "shard"))

        def different(batches):
            keys = [np.frombuffer(k, "<i8") for b in batches for k in b.column("keys").to_pylist()]
            if keys:
                yield _rows([np.unique(np.concatenate(keys))], ["g"], [pa.int64()])

        logs = log_probabilities(asked.mapInArrow(different, "g long"), seen, gammas, order)
        logs = logs.withColumn("shard", F.pmod("g", F.lit(count)).cast("int"))

        def answer(shard, packed, table):
            table = table.sort_values("g")
            g, logp = table["g"].to_numpy(), table["logp"].to_numpy().astype("<f4")
            values = [logp[np.searchsorted(g, np.frombuffer(k, "<i8"))].tobytes() for k in packed["keys"]]
            return packed[["block", "keys"]].assign(logs=values)

        answers = asked.groupBy("shard").cogroup(logs.groupBy("shard")).applyInPandas(answer, "block int, keys binary, logs binary")

        def keep(batches):
            parts: dict[int, list] = {}
            for b in batches:
                for row in b.to_pylist():
                    parts.setdefault(row["block"], []).append((np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["logs"], "<f4")))
            for block, found in parts.items():
                g, p = (np.concatenate(x) for x in zip(*found))
                order_ = np.argsort(g)
                blocks.save(folder, f"logs-{block}", g=g[order_].astype(np.uint64), p=p[order_])
            yield _rows([list(parts)], ["block"], [pa.int32()])

        answers.repartition(count, "block").mapInArrow(keep, "block int").agg(F.count("*")).collect()

    def _texts(self) -> DataFrame:
        return self.docs.select(
            F.coalesce(F.col(self.id).cast("long"), F.lit(NULL_ID)).alias("__id"),
            F.coalesce(F.col(self.text), F.lit("")).cast("binary").alias("__text"),
        )

    @staticmethod
    def _slices(batches, limit: int = 2 << 20):
        for batch in batches:
            for part in slices(batch, "__text", limit):
                yield part.column("__id").to_numpy().astype(np.int64), part.column("__text")

    @staticmethod
    def _side(folder: str) -> dict:
        from pyspark import TaskContext

        return blocks.load(folder, f"trusted-{TaskContext.get().partitionId()}")

    @staticmethod
    def _has(side: dict, ids: np.ndarray, fold: int) -> np.ndarray:
        return np.isin(ids, side["ids"][side["fold"] == fold]) if side else np.zeros(len(ids), bool)

    @staticmethod
    def _same(side: dict, rows: tuple[int, int]) -> None:
        """A pass over a split must see the rows that it had when the trusted ones were marked."""
        expected = (int(side["rows"][0]), int(side["rows"][1])) if side else (0, 0)
        if rows != expected:
            raise RuntimeError("a split holds other rows than before; store the table first")

    def _mark(self, trusted: DataFrame, held_out: int) -> None:
        """Write for each split which of its ids are trusted, which of those set the limits instead of training, and
        the number and checksum of all its rows, by which every later pass knows that it sees the same split."""
        folder = self.folder
        places = self.docs.select(F.col(self.id).cast("long").alias("id"), F.spark_partition_id().alias("block"))
        fold = (F.pmod(F.xxhash64("id"), F.lit(held_out)) == 0).cast("int")
        known = trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).distinct().withColumn("known", F.lit(1))
        # 0 or 1 is the fold of a trusted id, -1 any other id
        found = places.join(known, "id", "left").select(
            "block", F.coalesce("id", F.lit(NULL_ID)).alias("id"), F.when(F.col("known") == 1, fold).otherwise(-1).alias("fold")
        )
        found = found.repartition(self.count, "block")

        def keep(batches):
            parts: dict[int, list] = {}
            for b in batches:
                block, i, f = (b.column(c).to_numpy() for c in ("block", "id", "fold"))
                for at_block, at in _by(block.astype(np.int64), np.arange(b.num_rows)):
                    parts.setdefault(at_block, []).append((i[at], f[at]))
            for block, found in parts.items():
                i, f = (np.concatenate(x) for x in zip(*found))
                rows = np.array(blocks.checksum(i), np.uint64)
                i, at = np.unique(np.where(f < 0, NULL_ID, i), return_index=True)
                blocks.save(folder, f"trusted-{block}", ids=i, fold=f[at], rows=rows)
            yield _rows([list(parts)], ["block"], [pa.int32()])

        found.mapInArrow(keep, "block int").agg(F.count("*")).collect()

    def score(self, lang: str) -> DataFrame:
        """The id, ``lang``, block and row_key of every row, with __tokens, __logp (natural, of all tokens), __worst
        (see ``worst_stretch``), __fresh (see ``least_fresh``) and __limits (whether the row sets limits)."""
        folder, order = self.folder, self.order
        names = [self.id, lang, "__row_key"]

        def run(batches):
            from pyspark import TaskContext

            block = TaskContext.get().partitionId()
            side, logs, seen_rows = Scorer._side(folder), blocks.load(folder, f"logs-{block}"), (0, 0)
            for batch in batches:
                for part in slices(batch, "__text", 2 << 20):
                    seen_rows = blocks.checksum(part.column("__id").to_numpy(), seen_rows)
                    g, row = grams(part.column("__text"), order)
                    place = np.minimum(np.searchsorted(logs["g"], g), len(logs["g"]) - 1)
                    if not (logs["g"][place] == g).all():
                        raise RuntimeError("a split holds other rows than before; store the table first")
                    n = part.num_rows
                    more = [
                        pa.array(np.full(n, block, np.int32)),
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(np.bincount(row, logs["p"][place], n)),
                        pa.array(worst_stretch(row, logs["p"][place], n)),
                        pa.array(least_fresh(row, g, n)),
                        pa.array(Scorer._has(side, part.column("__id").to_numpy().astype(np.int64), 1)),
                    ]
                    yield pa.RecordBatch.from_arrays(part.columns[:3] + more, names=[*names, "__block", "__tokens", "__logp", "__worst", "__fresh", "__limits"])
            Scorer._same(side, seen_rows)

        chosen = self.docs.select(self.id, lang, blocks.row_key(self.id, self.text).alias("__row_key"), F.coalesce(F.col(self.id).cast("long"), F.lit(NULL_ID)).alias("__id"), F.coalesce(F.col(self.text), F.lit("")).cast("binary").alias("__text"))
        fields = [T.StructField("__block", T.IntegerType()), T.StructField("__tokens", T.LongType()), T.StructField("__logp", T.DoubleType()), T.StructField("__worst", T.DoubleType()), T.StructField("__fresh", T.DoubleType()), T.StructField("__limits", T.BooleanType())]
        return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:3], *fields]))


def _perplexity() -> Column:
    """Of a text with at least one byte; null for an empty one."""
    return F.when(F.col("__tokens") > 1, F.exp(-F.col("__logp") / F.col("__tokens")))


def _key(lang: str) -> Column:
    """A non-null stand-in for the language, so that rows without one are a language of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("null"))


def limits(scores: DataFrame, lang: str, quantile: float, slack: float, least: int, short: float) -> tuple[DataFrame, dict]:
    """(key, typical, stretch) of each language, and the limits of all together with the short-text term.

    All come from the held-out trusted texts, in logarithms. The three judgements share the part
    1 - ``quantile`` that may be lost. The mean over few tokens strays further, so a text of n may pass by
    s / sqrt(n); s is the one with the lowest mean limit that still lets that share of the held-out texts
    pass. Where the texts are too few to show so rare a loss, the distance from their median is carried on
    as an exponential tail goes. Fewer than ``least`` texts cannot say any of this: then the ``quantile``
    is widened by ``slack``, and s is ``short``. A language with fewer than ``least`` takes the larger of
    its own and the common limit.
    """
    span = F.least("__tokens", F.lit(CELL * STRETCH))
    held = blocks.cut(
        scores.where("__limits AND __tokens > 1").select(
            _key(lang).alias("key"), (-F.col("__logp") / F.col("__tokens")).alias("x"), F.col("__worst").alias("w"),
            F.col("__fresh").alias("fresh"), (1 / F.sqrt("__tokens")).alias("r"), (1 / F.sqrt(span)).alias("rw"),
        )
    )
    share = 1 - (1 - quantile) / 3
    at = lambda value, q: F.percentile_approx(value, F.lit(q), F.lit(10_000))
    tried = [k / 4 for k in range(17)]
    means = [(at(F.col("x") - s * F.col("r"), share) + s * F.avg("r")).alias(f"s{k}") for k, s in enumerate(tried)]
    found = held.agg(F.count("*").alias("n"), *means).first()
    if found.n < least:
        s, taken, part, wider = short, 0.0, quantile, float(np.log(slack))
    else:
        s = min(zip([found[f"s{k}"] for k in range(len(tried))], tried))[1]
        taken, part, wider = s, share, 0.0
    n = F.count("*")
    reach = F.when((n >= least) & F.lit(found.n >= least), F.greatest(F.lit(1.0), float(np.log(0.5 / (1 - share))) / F.log(n / 2))).otherwise(1.0)

    def limit(value, q):
        return at(value, 0.5) + reach * (at(value, q) - at(value, 0.5))

    typical = (limit(F.col("x") - taken * F.col("r"), part) + wider).alias("typical")
    stretch = (limit(F.col("w") - taken * F.col("rw"), part) + wider).alias("stretch")
    fresh = (limit(F.col("fresh"), 1 - part) * float(np.exp(-wider))).alias("fresh")
    pooled = held.agg(typical, stretch, fresh).first().asDict() | {"short": s}
    by = held.groupBy("key").agg(typical, stretch, F.count("*").alias("n"))
    own = lambda c: F.when(F.col("n") < least, F.greatest(c, F.lit(pooled[c]))).otherwise(F.col(c)).alias(c)
    return by.select("key", own("typical"), own("stretch")), pooled


def _judged(scorer: Scorer, lang: str, quantile: float, slack: float, least: int, short: float) -> DataFrame:
    """(id, lang, block, row_key, __tokens, __perplexity, __threshold, __kept) of every row, scored once."""
    rows = cut_lineage(scorer.score(lang))
    by, pooled = limits(rows, lang, quantile, slack, least, short)
    by = by.select(F.col("key").alias("__key"), F.col("typical").alias("__typical"), F.col("stretch").alias("__stretch"))
    rows = rows.withColumns({"__perplexity": _perplexity(), "__key": _key(lang)}).join(by, "__key", "left")
    common = lambda c: F.lit(pooled[c]).cast("double")
    wider = lambda n: pooled["short"] / F.sqrt(n)
    rows = rows.withColumn("__threshold", F.exp(F.coalesce("__typical", common("typical")) + wider(F.col("__tokens"))))
    stretch = F.coalesce("__stretch", common("stretch")) + wider(F.least("__tokens", F.lit(CELL * STRETCH)))
    usual = (F.col("__perplexity") <= F.col("__threshold")) & (F.col("__worst") <= stretch) & (F.col("__fresh") >= common("fresh"))
    return rows.withColumn("__kept", F.col("__perplexity").isNotNull() & F.coalesce(usual, F.col("__threshold").isNull()))


def trusted_ids(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Ids all of whose labels say good and not toxic."""
    marks = labels.groupBy(id).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return marks.where("q = 1 AND t = 0").select(id)


def judge_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = 5,
    held_out: int = 4,
    quantile: float = 0.99,
    slack: float = 1.25,
    least: int = 50,
    short: float = 2.0,
) -> DataFrame:
    """One row per row of ``docs``: id, lang, n_tokens, perplexity (per byte), threshold, kept.

    ``trusted`` names the ids of trusted text in its first column. All of it is used: one document
    in ``held_out``, by a hash of the id, sets the limits, the others train the model.

    1. Each split counts the n-grams of its trusted texts; the sums are sharded by n-gram. Orders,
       discounts, back-off weights and probabilities follow by aggregations and joins (``fit``).
    2. Each split asks for its different n-grams once. They are joined with the tables, order by
       order, and the answers go to a file of the split (see ``blocks``, which also says what
       ``docs`` must be). Texts never move.
    3. Each split sums the answers over its whole texts and over their stretches. A text is kept if its
       perplexity and that of its worst stretch are within limits by language (null is a language), and
       if no piece of it repeats its n-grams more than trusted texts do. Repeated runs are likely for
       the model, so perplexity alone lets them pass. All limits come from the held-out trusted texts;
       ``slack`` and ``short`` hold only where these are fewer than ``least`` (see ``limits``).
       ``threshold`` is the limit of the perplexity.

    A null or empty text has no perplexity and is not kept. Without held-out trusted text there is
    no limit, and all other texts are kept. Null ids are never trusted; rows that repeat an id are
    trusted together. An empty table gives an empty table; other columns are not looked at.
    """
    scorer = Scorer(docs, trusted, id, text, order, held_out)
    rows = _judged(scorer, lang, quantile, slack, least, short)
    names = {"__tokens": "n_tokens", "__perplexity": "perplexity", "__threshold": "threshold", "__kept": "kept"}
    return rows.select(id, lang, *[F.col(a).alias(b) for a, b in names.items()])


def keep_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = 5,
    held_out: int = 4,
    quantile: float = 0.99,
    slack: float = 1.25,
    least: int = 50,
    short: float = 2.0,
) -> DataFrame:
    """The rows that ``judge_quality`` keeps, with all their columns, each row judged by itself."""
    scorer = Scorer(docs, trusted, id, text, order, held_out)
    kept = _judged(scorer, lang, quantile, slack, least, short).where("__kept")
    decisions = kept.select(F.col("__block").alias("block"), F.col("__row_key").alias("row_key"), F.lit(1).alias("copies"))
    return blocks.repeat_rows(docs, decisions, id, text)
