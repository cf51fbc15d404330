"""T, U and D: top-k, unions and repeats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.rows import explode_into
from chalkline.operators.ordered import carry_lag, time_chunk

# English words left out of word counts (three letters and more; shorter words
# never count).
ENGLISH_STOP = """
myself our ours ourselves you your yours yourself yourselves him his himself she her hers herself its
itself they them their theirs themselves what which who whom this that these those are was were been
being have has had having does did doing the and but because until while for with about against between
into through during before after above below from down out off over under again further then once here
there when where why how all both each few more most other some such nor not only own same than too very
can will just don should now ain aren couldn didn doesn hadn hasn haven isn mightn mustn needn shan
shouldn wasn weren won wouldn hello please thank thanks yes okay pls thx
""".split()
# Romanised Urdu words left out.
URDU_STOP = """
hai hain tha thi the mein par aur lekin magar kya kaise kab kahan kyun kon kis jis woh yeh main hum aap
tum jee han
""".split()


# T1 -----------------------------------------------------------------------------


def page(df: DataFrame, keys: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Ordered page; the caller gives a unique last key."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


# T2, T3, W3 -----------------------------------------------------------------------


def word_counts(
    df: DataFrame, text: str = "text", keys: Sequence[str] = (), stop: Sequence[str] = (*ENGLISH_STOP, *URDU_STOP)
) -> DataFrame:
    """Countable words per key: ASCII word characters, 3 to 19 long, no stop words, not only digits."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    word = F.col("word")
    digits = F.left("word", F.lit(1)).between("0", "9") & word.rlike(r"^\d+$")
    words = explode_into(df, list(keys), F.split(lower, r"\W+"), "word")
    kept = words.filter(F.length("word").between(3, 19) & ~word.isin(sorted(set(stop))) & ~digits)
    return kept.groupBy(*keys, "word").agg(F.count("*").alias("count"))


def word_frequency(df: DataFrame, text: str = "text", k: int = 100) -> DataFrame:
    """The ``k`` most frequent words."""
    return word_counts(df, text).orderBy(F.col("count").desc(), "word").limit(k)


def engagement_keywords(
    messages: DataFrame, session: str = "session_id", text: str = "text", longer_than: int = 10, sessions: int = 100, k: int = 20
) -> DataFrame:
    """Frequent words of user rows in long sessions; the ``sessions`` longest ones, by key on ties."""
    busy = (
        messages.groupBy(session)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > longer_than)
        .orderBy(F.col("n").desc(), session)
        .limit(sessions)
        .select(session)
    )
    rows = messages.filter(F.col("role") == "user").join(busy, session, "left_semi")
    return word_frequency(rows, text, k)


# U1 - U3 ----------------------------------------------------------------------------


def activity_timeline(sources: Mapping[str, tuple[DataFrame, str]], user_only: Sequence[str] = ()) -> DataFrame:
    """``(user_id, at, activity_type)`` of several tables; tables in ``user_only`` keep rows the
    user wrote."""
    out = None
    for name, (df, ts) in sources.items():
        if name in user_only:
            df = df.filter(F.col("role") == "user")
        part = df.select("user_id", F.col(ts).alias("at"), F.lit(name).alias("activity_type"))
        out = part if out is None else out.unionByName(part)
    return out


def any_feature_users(*tables: DataFrame) -> DataFrame:
    """Users in at least one table."""
    out = None
    for df in tables:
        part = df.select("user_id")
        out = part if out is None else out.union(part)
    return out.distinct()


def feature_membership(**tables: DataFrame) -> DataFrame:
    """One row per user with a flag per table; any intersection or difference is a filter on it."""
    long = None
    for name, df in tables.items():
        part = df.select("user_id", F.lit(name).alias("_set"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("user_id").agg(*[F.max(F.col("_set") == name).alias(name) for name in tables])


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Users in both tables."""
    return a.select("user_id").intersect(b.select("user_id"))


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Users in the first table only."""
    return a.select("user_id").distinct().exceptAll(b.select("user_id").distinct())


# D1, D2 ----------------------------------------------------------------------------------


def repeat_within(df: DataFrame, keys: Sequence[str], ts: str = "created_at", tie: str = "id", seconds: int = 300) -> DataFrame:
    """Flag rows that repeat the same keys at most ``seconds`` after the row before."""
    lagged = carry_lag(df, keys, [ts, tie], [ts], time_chunk(ts))
    gap = F.unix_micros(ts) - F.unix_micros(f"prev_{ts}")
    return lagged.withColumn("is_repeat", F.coalesce(gap <= seconds * 1_000_000, F.lit(False))).drop(f"prev_{ts}")


def cooling_down(df: DataFrame, key: str, as_of: str, ts: str = "completed_at", seconds: int = 3600) -> DataFrame:
    """Senders whose last completed row is less than the cool-down old, with that time."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECOND")
    return (
        df.filter((F.col("status") == "completed") & (F.col(ts) >= since) & (F.col(ts) <= F.lit(as_of).cast("timestamp")))
        .groupBy(key)
        .agg(F.max(ts).alias("last_completed"))
    )


def distinct_cascade(catalog: DataFrame, column: str, **chosen) -> DataFrame:
    """Sorted distinct values of one column under the chosen filters; blanks are dropped."""
    df = catalog
    for name, value in chosen.items():
        df = df.filter(F.col(name) == value)
    values = df.filter(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != "").select(column).distinct()
    return values.orderBy(column)
