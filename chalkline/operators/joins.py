"""J: joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import norms
from chalkline.functions.dates import season
from chalkline.functions.maths import half_up
from chalkline.functions.names import bigrams, dice_of
from chalkline.functions.rows import explode_into

ACTIVITY_DAYS = {"24h": 1, "7d": 7, "30d": 30}


# J1, J2 ------------------------------------------------------------------------


def users_with_activity(users: DataFrame, messages: DataFrame) -> DataFrame:
    """Every user with last activity and message counts. Messages are counted per user
    before the join, so the join moves one row per user."""
    per_user = messages.groupBy(F.col("user_id").alias("id")).agg(
        F.max("created_at").alias("last_activity"),
        F.count("*").alias("total_messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("message_type") == "voice").alias("voice_messages"),
    )
    counts = ["total_messages", "user_messages", "voice_messages"]
    return users.join(per_user, "id", "left").fillna(0, counts)


def activity_order(variant: str = "nulls_last") -> list[Column]:
    """The two sort rules of the user list."""
    if variant == "nulls_last":
        return [F.col("last_activity").desc_nulls_last(), F.col("created_at").desc_nulls_first(), F.col("id").asc()]
    if variant == "coalesce":
        return [F.coalesce("last_activity", "created_at").desc_nulls_first(), F.col("id").asc()]
    raise ValueError(f"unknown order {variant!r}")


def recent_activity(messages: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` messages of known users with user fields."""
    known = messages.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    latest = known.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(n)
    return latest.join(users.select(F.col("id").alias("user_id"), "phone_number", "name"), "user_id")


# J3 -----------------------------------------------------------------------------


def day_spine(spark, lo: str, hi: str, name: str = "date") -> DataFrame:
    """One row per day of ``[lo, hi]``."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).alias(name)
    )


def date_spine_join(spark, lo: str, hi: str, **series: tuple[DataFrame, str]) -> DataFrame:
    """Daily counts of several tables side by side, zeros filled. ``series`` maps a column
    name to ``(table, time column)``. The tables are counted in one union, so the spine meets
    one small table."""
    parts = [
        df.filter(F.col(ts) >= F.lit(lo).cast("timestamp")).select(
            F.to_date(ts).alias("date"), F.lit(name).alias("series")
        )
        for name, (df, ts) in series.items()
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    counts = long.groupBy("date").agg(*[F.count_if(F.col("series") == name).alias(name) for name in series])
    return day_spine(spark, lo, hi).join(counts, "date", "left").fillna(0, list(series))


# J4 -----------------------------------------------------------------------------


def reachable(users: DataFrame) -> DataFrame:
    return users.filter(F.col("registration_completed") & F.col("phone_number").isNotNull())


def _since(messages: DataFrame, as_of: str, days: int) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAY")
    return messages.filter((F.col("role") == "user") & (F.col("created_at") >= since))


def audience(
    users: DataFrame,
    messages: DataFrame,
    as_of: str,
    activity: str = "all",
    country: str = "all",
    countries: Sequence[str] = ("92", "94"),
) -> DataFrame:
    """Registered users with a phone, optionally active lately or with a phone prefix."""
    if activity != "all" and activity not in ACTIVITY_DAYS:
        raise ValueError(f"invalid activity filter {activity!r}")
    if country != "all" and country not in countries:
        raise ValueError(f"invalid country filter {country!r}")
    df = reachable(users)
    if country != "all":
        df = df.filter(F.col("phone_number").startswith(country))
    if activity != "all":
        active = _since(messages, as_of, ACTIVITY_DAYS[activity]).select(F.col("user_id").alias("id")).distinct()
        df = df.join(active, "id", "left_semi")
    return df


def audience_matrix(users: DataFrame, messages: DataFrame, as_of: str, countries: Sequence[str] = ("92", "94")) -> DataFrame:
    """Counts for every activity window and country in one pass over the last messages."""
    last = _since(messages, as_of, max(ACTIVITY_DAYS.values())).groupBy(F.col("user_id").alias("id")).agg(
        F.max("created_at").alias("last_at")
    )
    now = F.lit(as_of).cast("timestamp")
    joined = reachable(users).join(last, "id", "left")
    flags = [("all", F.lit(True))] + [
        (name, F.coalesce(F.col("last_at") >= now - F.expr(f"INTERVAL {d} DAY"), F.lit(False)))
        for name, d in ACTIVITY_DAYS.items()
    ]
    aggs = []
    for name, flag in flags:
        aggs.append(F.count_if(flag).alias(f"{name}_all"))
        aggs += [F.count_if(flag & F.col("phone_number").startswith(c)).alias(f"{name}_{c}") for c in countries]
    one = joined.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("activity"),
            F.col(f"{name}_all").alias("everyone"),
            *[F.col(f"{name}_{c}").alias(f"country_{c}") for c in countries],
        )
        for name, _ in flags
    ]
    return one.select(F.inline(F.array(*rows)))


# J5 -----------------------------------------------------------------------------


def missing_from(expected: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """Expected rows whose key was never seen."""
    return expected.join(seen.select(on).distinct(), on, "left_anti")


def mark_missing_absent(heard: DataFrame, roster: DataFrame) -> DataFrame:
    """``heard(student_id, name, status, confidence)`` plus one absent row per silent student."""
    silent = missing_from(roster, heard.filter(F.col("student_id").isNotNull()), "student_id").select(
        "student_id",
        F.col("student_name").alias("name"),
        F.lit("absent").alias("status"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("auto_marked"),
    )
    return heard.withColumn("auto_marked", F.lit(False)).unionByName(silent)


# J6 -----------------------------------------------------------------------------


def interval_join(
    starts: DataFrame, events: DataFrame, buckets: Sequence[tuple[str, int, int]], first_day: str | None = "day0"
) -> DataFrame:
    """Per user, whether an event fell into each half-open day offset ``[from, to)`` after the
    start; ``first_day`` compares calendar dates instead.

    ``starts(user_id, started_at, ...)`` has one row per user and ``events(user_id, at)``. Before the
    join the events are reduced to first and last per user and calendar day. That loses nothing:
    bucket borders are whole days apart, so a day holds at most one border of a bucket, and whether an
    event lies on the right side of it shows in the day's first or last event. A very active user
    reaches the join with one row per day.
    """
    if any(hi <= lo for _, lo, hi in buckets):
        raise ValueError("a bucket spans at least one day")
    day_us = 86_400_000_000
    people = starts.select("user_id", "started_at")
    daily = events.groupBy("user_id", F.to_date("at").alias("_day")).agg(
        F.min("at").alias("_first"), F.max("at").alias("_last")
    )
    joined = daily.join(people, "user_id")
    start = F.unix_micros("started_at")
    first, last = F.unix_micros("_first") - start, F.unix_micros("_last") - start
    flags = [F.max((last >= lo * day_us) & (first < hi * day_us)).alias(name) for name, lo, hi in buckets]
    if first_day:
        flags.insert(0, F.max(F.col("_day") == F.to_date("started_at")).alias(first_day))
    names = ([first_day] if first_day else []) + [b[0] for b in buckets]
    per_user = joined.groupBy("user_id").agg(*flags)
    return starts.join(per_user, "user_id", "left").fillna(False, names)


# J7 - J9 --------------------------------------------------------------------------


def threshold_lookup(
    df: DataFrame,
    value: str = "wcpm",
    grade: str = "grade_level",
    language: str = "language",
    second_language: Column | None = None,
    day: Column | None = None,
    season_col: Column | None = None,
) -> DataFrame:
    """Benchmark range, on-track flag and percentile of a reading rate. The norms are a
    literal map, so rows stay where they are."""
    l2 = F.lit(True) if second_language is None else second_language
    when_ = season(day) if season_col is None else season_col
    lang = F.when((F.col(language) == "ur") & l2, "ur").otherwise("en")
    key = F.concat_ws("|", F.col(grade).cast("string"), lang, when_)
    rows: list[Column] = []
    for (g, lng, ssn), cuts in norms.WORD_NORMS.items():
        rows += [F.lit(f"{g}|{lng}|{ssn}"), F.array(*[F.lit(c) for c in cuts])]
    wide = df.withColumns({"_cuts": F.create_map(*rows)[key], "_rate": half_up(F.col(value)), "_lang": lang})
    cuts, rate = F.col("_cuts"), F.col("_rate")

    def fallback(i: int) -> Column:
        base = F.coalesce(
            norms.lookup({g: r[i] for g, r in norms.WORD_FALLBACK.items()}, F.col(grade), "int"),
            F.lit(norms.WORD_FALLBACK_OTHER[i]),
        )
        return F.when(F.col("_lang") == "ur", half_up(base * norms.URDU_FACTOR)).otherwise(base)

    low = F.coalesce(F.get(cuts, F.lit(1)), fallback(0)).cast("int")
    high = F.coalesce(F.get(cuts, F.lit(3)), fallback(1)).cast("int")
    reached = F.lit(10)
    for i, p in enumerate(norms.PERCENTILES):
        reached = F.when(F.get(cuts, F.lit(i)) <= rate, F.lit(p)).otherwise(reached)
    return wide.withColumns(
        {
            "benchmark_min": low,
            "benchmark_max": high,
            "on_track_now": rate >= low,
            "percentile_rank": F.when(rate == 0, 1).otherwise(reached),
        }
    ).drop("_cuts", "_rate", "_lang")


def band_lookup(df: DataFrame, value: str = "lcpm", grade: str = "grade_level", language: str = "language") -> DataFrame:
    """Letter-naming band from the fall norms, defaults when there are none."""
    rows: list[Column] = []
    for (g, lng), cuts in norms.LETTER_NORMS.items():
        rows += [F.lit(f"{g}|{lng}"), F.array(*[F.lit(c) for c in cuts])]
    key = F.concat_ws("|", F.col(grade).cast("string"), F.coalesce(F.col(language), F.lit("en")))
    wide = df.withColumn("_cuts", F.create_map(*rows)[key])
    cuts, rate = F.col("_cuts"), F.col(value)
    band = F.lit(95)
    for i in reversed(range(len(norms.LETTER_PERCENTILES))):
        band = F.when(rate < F.get(cuts, F.lit(i)), F.lit(norms.LETTER_PERCENTILES[i])).otherwise(band)
    low = F.coalesce(F.get(cuts, F.lit(2)), F.lit(norms.LETTER_FALLBACK[0]))
    return wide.withColumns(
        {
            "benchmark_min": low,
            "benchmark_max": F.coalesce(F.get(cuts, F.lit(4)), F.lit(norms.LETTER_FALLBACK[1])),
            "on_track_now": rate >= low,
            "percentile_rank": F.when(cuts.isNull(), 50).otherwise(band),
        }
    ).drop("_cuts")


def grade_scale_join(df: DataFrame, pct: str = "percentage", board: str | Column = "board") -> DataFrame:
    """Grade, grade points, division and pass flag on the board's scale."""
    scale = norms.board_scale(board if isinstance(board, Column) else F.col(board))
    graded = df.withColumn("_g", norms.grade_of(F.col(pct), scale))
    return graded.withColumns(
        {
            "grade": F.col("_g.grade"),
            "gpa": F.col("_g.gpa"),
            "division": F.col("_g.division"),
            "passed": ~F.col("_g.grade").isin(norms.FAILING),
        }
    ).drop("_g")


# J10 ------------------------------------------------------------------------------


def self_compare(sessions: DataFrame) -> DataFrame:
    """Invited friend against inviter on the same quiz. One run per student and quiz counts
    for the inviter: the earliest completed one."""
    runs = (
        sessions.filter(F.col("status") == "completed")
        .groupBy(F.col("quiz_id"), F.col("student_id").alias("invited_by_student_id"))
        .agg(F.min_by("correct_answers", F.struct("created_at", "session_id")).alias("inviter_correct"))
    )
    theirs = F.coalesce("correct_answers", F.lit(0))
    mine = F.coalesce("inviter_correct", F.lit(0))
    return (
        sessions.filter((F.col("status") == "completed") & F.col("invited_by_student_id").isNotNull())
        .join(runs, ["quiz_id", "invited_by_student_id"])
        .select(
            "session_id",
            "quiz_id",
            "student_id",
            "invited_by_student_id",
            theirs.alias("friend_correct"),
            mine.alias("inviter_correct"),
            F.when(theirs > mine, "ahead").when(theirs < mine, "behind").otherwise("tie").alias("outcome"),
        )
    )


# J11 ------------------------------------------------------------------------------


def fuzzy_match(names: DataFrame, roster: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Best roster entry per heard name within a class.

    ``names(name_id, class_id, name)`` and ``roster(student_id, class_id, student_name, father_name,
    position)``. The score is the better of the name and name-plus-father Dice score and must exceed
    the threshold; the first roster position wins a tie. A class with names but no match gives 0.3,
    a class without roster 0.5.

    Equal names are compared once. Two texts can only score above 0.4 when they share a letter pair
    among the rarest of each (prefix filter, exact), when one holds the other, or when they are
    equal; only such pairs meet.
    """
    if threshold < 0.4:
        raise ValueError("the pair filter is exact from 0.4 up")
    heard = names.select("class_id", F.trim(F.lower("name")).alias("text")).distinct()
    texts = F.array_compact(
        F.array(
            F.trim(F.lower("student_name")),
            F.when(
                F.coalesce("father_name", F.lit("")) != "",
                F.trim(F.lower(F.concat_ws(" ", "student_name", "father_name"))),
            ),
        )
    )
    members = explode_into(roster, ["class_id", "student_id", "position"], texts, "text")
    known = members.select("class_id", "text").distinct()
    both = heard.withColumn("side", F.lit("heard")).unionByName(known.withColumn("side", F.lit("known")))
    chars = F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))
    grams = explode_into(both, ["class_id", "side", "text"], bigrams(F.col("text")), "gram")
    weights = grams.groupBy("class_id", "gram").agg(F.count_if(F.col("side") == "known").alias("_seen"))
    order = Window.partitionBy("class_id", "side", "text")
    ranked = (
        grams.join(weights, ["class_id", "gram"])
        .withColumn("place", F.row_number().over(order.orderBy("_seen", "gram")))
        .withColumn("size", F.count("*").over(order))
    )
    # a score above 0.4 needs more than a quarter of the letter pairs shared
    in_prefix = F.col("place") <= F.col("size") - F.floor(F.col("size") / 4)
    rarest = F.col("place") == 1
    is_heard = F.col("side") == "heard"
    # ways to meet: both prefixes; the rarest pair of one text anywhere in the other; a single letter
    ways = F.array_compact(
        F.array(
            F.when(in_prefix, "prefix"),
            F.when(~is_heard | rarest, "heard inside"),
            F.when(is_heard | rarest, "known inside"),
        )
    )
    letters = explode_into(both, ["class_id", "side", "text"], chars, "gram")
    single = F.length("text") == 1
    one = F.array_compact(F.array(F.when(~is_heard | single, "heard letter"), F.when(is_heard | single, "known letter")))
    keyed = ranked.select("class_id", "side", "text", "gram", F.explode(ways).alias("way")).unionByName(
        letters.select("class_id", "side", "text", "gram", F.explode(one).alias("way"))
    )
    left = keyed.filter("side = 'heard'").select("class_id", "gram", "way", F.col("text").alias("heard"))
    right = keyed.filter("side = 'known'").select("class_id", "gram", "way", F.col("text").alias("known"))
    scored = (
        left.join(right, ["class_id", "gram", "way"])
        .select("class_id", "heard", "known")
        .distinct()
        .withColumns({"_a": bigrams(F.col("heard")), "_b": bigrams(F.col("known"))})
        .withColumn("score", dice_of(F.col("heard"), F.col("known"), F.col("_a"), F.col("_b")))
        .drop("_a", "_b")
    )
    # only the first of equal roster texts can win
    first = members.groupBy("class_id", F.col("text").alias("known")).agg(
        F.max(F.struct((-F.col("position")).alias("early"), "student_id")).alias("first")
    ).select("class_id", "known", "first.*")
    # the threshold is applied to the best score, not to each pair: a filter on the pair would be
    # pushed below the score and compute it twice
    best = (
        scored.join(first, ["class_id", "known"])
        .groupBy("class_id", "heard")
        .agg(
            F.max_by(
                F.struct("student_id", "score"), F.struct("score", "early")
            ).alias("best")
        )
        .filter(F.col("best.score") > threshold)
    )
    classes = roster.select("class_id").distinct().withColumn("_has_roster", F.lit(True))
    return (
        names.withColumn("heard", F.trim(F.lower("name")))
        .join(best, ["class_id", "heard"], "left")
        .join(classes, "class_id", "left")
        .select(
            "name_id",
            "class_id",
            "name",
            F.col("best.student_id").alias("student_id"),
            F.coalesce("best.score", F.when(F.col("_has_roster"), 0.3).otherwise(0.5)).alias("confidence"),
        )
    )


# J12, J13 ---------------------------------------------------------------------------


def topic_to_chapter(topics: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapter per topic: exact keyword first, then a title that holds the topic.

    ``topics(topic_id, curriculum, topic)``, ``toc(curriculum, grade, chapter_number,
    chapter_title, keywords)``. The smallest (grade, chapter) wins. Equal topics are looked up
    once; the title search joins on the topic's first three letters, which the title must hold.
    """
    wanted = topics.withColumn("_t", F.trim(F.lower("topic")))
    distinct = wanted.select("curriculum", "_t").distinct()
    chapter = F.struct("grade", "chapter_number", "chapter_title")
    by_word = toc.select("curriculum", F.explode("keywords").alias("_t"), chapter.alias("chapter"))
    exact = (
        distinct.join(by_word, ["curriculum", "_t"])
        .groupBy("curriculum", "_t")
        .agg(F.min("chapter").alias("chapter"))
        .withColumn("matched_by", F.lit("keyword"))
    )
    rest = distinct.join(exact, ["curriculum", "_t"], "left_anti").withColumn("_stem", F.left("_t", F.lit(3)))
    title = F.lower("chapter_title")
    stems = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(title), F.lit(1))),
                lambda i: F.array(F.substring(title, i, F.lit(1)), F.substring(title, i, F.lit(2)), F.substring(title, i, F.lit(3))),
            )
        )
    )
    # equal titles are searched once, for their smallest chapter
    by_title = toc.groupBy("curriculum", "chapter_title").agg(F.min(chapter).alias("chapter"))
    titles = explode_into(
        by_title, ["curriculum", title.alias("_title"), "chapter"], F.array_append(stems, F.lit("")), "_stem"
    )
    # the optimizer sizes the exploded titles as if each had one stem, and would broadcast them
    inside = (
        rest.join(titles.hint("merge"), ["curriculum", "_stem"])
        .filter(F.contains("_title", "_t"))
        .groupBy("curriculum", "_t")
        .agg(F.min("chapter").alias("chapter"))
        .withColumn("matched_by", F.lit("title"))
    )
    found = exact.unionByName(inside)
    return wanted.join(found, ["curriculum", "_t"]).select(
        "topic_id", "curriculum", "topic", "matched_by", "chapter.grade", "chapter.chapter_number", "chapter.chapter_title"
    )


def ready_plans(matched: DataFrame, plans: DataFrame) -> DataFrame:
    """Completed pre-made plans of matched chapters."""
    done = plans.filter(F.col("generation_status") == "completed").drop("generation_status")
    return matched.join(done, ["curriculum", "grade", "chapter_number"])


def resolve_selection(selections: DataFrame, chapters: DataFrame) -> DataFrame:
    """``selections(bundle_id, groups array<struct<grade, subject, chapters array<int>>>)`` to
    chapter rows with a file key, each once per group, in group then chapter order."""
    groups = selections.select("bundle_id", F.posexplode("groups").alias("group_no", "g"))
    wanted = groups.select(
        "bundle_id",
        "group_no",
        F.col("g.grade").alias("grade"),
        F.col("g.subject").alias("subject"),
        F.explode(F.array_distinct("g.chapters")).alias("chapter"),
    ).filter(F.col("grade").isNotNull() & (F.coalesce("subject", F.lit("")) != ""))
    available = chapters.filter(F.coalesce("file_key", F.lit("")) != "")
    return wanted.join(available, ["grade", "subject", "chapter"]).orderBy("bundle_id", "group_no", "chapter")


# J14, J15 ----------------------------------------------------------------------------


def fanout_safe_counts(users: DataFrame, key: str, **facts: DataFrame) -> DataFrame:
    """Facts per group of users. Facts of all kinds are counted per user in one union first,
    so several facts of one user never multiply."""
    long = None
    for name, fact in facts.items():
        part = fact.select(F.col("user_id").alias("id"), F.lit(name).alias("_fact"))
        long = part if long is None else long.unionByName(part)
    per_user = long.groupBy("id").agg(*[F.count_if(F.col("_fact") == name).alias(name) for name in facts])
    return (
        users.select("id", key)
        .join(per_user, "id", "left")
        .groupBy(key)
        .agg(F.count("*").alias("users"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in facts])
    )


def broadcast_scalars(*frames: DataFrame) -> DataFrame:
    """One-row aggregates side by side. Every frame must be a global aggregate (one row)."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.crossJoin(F.broadcast(frame))
    return out
