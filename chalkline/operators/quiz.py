"""Z: quiz reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.bands import class_band, mastery
from chalkline.functions.maths import half_up, whole_pct
from chalkline.operators.ordered import top_n
from chalkline.operators.windows import dense_index

CLUSTER = 0.5
OPTIONS = ["A", "B", "C", "D"]


def session_mastery(answers: DataFrame) -> DataFrame:
    """Answered, correct, mastery percentage and level per session. The level comes from the
    exact share, the percentage is rounded."""
    counts = answers.groupBy("session_id").agg(
        F.count("*").alias("answered"), F.count_if("is_correct").alias("correct")
    )
    return counts.withColumns(
        {
            "mastery_percentage": whole_pct(F.col("correct"), F.col("answered")),
            "mastery_level": mastery(F.col("correct") / F.col("answered") * 100),
        }
    )


def mastery_of_counts(sessions: DataFrame) -> DataFrame:
    """Z1, shared-quiz form: the level comes from the rounded percentage; nothing answered is 0."""
    pct = whole_pct(F.coalesce("correct_answers", F.lit(0)), F.coalesce("total_questions_answered", F.lit(0)))
    return sessions.withColumn("mastery_percentage", pct).withColumn("mastery_level", mastery(F.col("mastery_percentage")))


def _picks(answers: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Answers of the given sessions counted per (key, question, option)."""
    known = answers.join(sessions.select("session_id", key), "session_id")
    return known.groupBy(key, "question_id", "selected_option").agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("right"), F.count_if(~F.col("is_correct")).alias("wrong")
    )


def option_text(letter: Column) -> Column:
    """Text of an option by its letter, else the letter itself."""
    out = letter
    for option in reversed(OPTIONS[:3]):
        out = F.when(letter == option, F.coalesce(f"option_{option.lower()}", letter)).otherwise(out)
    return F.when(letter.isNotNull(), out)


def _worst(questions: DataFrame, key: str, limit: int) -> DataFrame:
    return top_n(questions, [key], [F.col("miss_rate").desc(), F.col("question_id").asc()], limit, "place")


def missed_roster(sessions: DataFrame, answers: DataFrame, questions: DataFrame, limit: int = 3) -> DataFrame:
    """The ``limit`` most missed questions per quiz over completed sessions.

    A wrong option is named when it took at least half of the wrong answers (the first letter on
    ties); its misconception comes from the option's note, else from the question's. Options per
    question are few, so picks are counted before anything is ranked."""
    picks = _picks(answers, sessions.filter(F.col("status") == "completed"), "quiz_id")
    keyed = picks.join(
        questions.filter(F.coalesce("question_text", F.lit("")) != ""), ["quiz_id", "question_id"]
    )
    is_wrong_pick = F.col("selected_option").isNotNull() & (F.col("selected_option") != F.col("correct_option"))
    first = F.struct((-F.col("n")).alias("few"), F.col("selected_option").alias("letter"))
    totals = keyed.groupBy("quiz_id", "question_id").agg(
        F.sum("n").alias("total"),
        F.sum("right").alias("correct_count"),
        F.min(F.when(is_wrong_pick, first)).alias("_top"),
        *[
            F.first(c).alias(c)
            for c in ("question_text", "correct_option", "option_a", "option_b", "option_c", "misconception_feedback", "distractor_misconceptions")
        ],
    )
    wrong = F.col("total") - F.col("correct_count")
    top, count = F.col("_top.letter"), -F.col("_top.few")
    cluster = F.coalesce((wrong > 0) & (count / wrong >= CLUSTER), F.lit(False))
    note = F.nullif(F.col("distractor_misconceptions")[top], F.lit(""))
    general = F.nullif("misconception_feedback", F.lit(""))
    rated = totals.filter((F.col("total") >= 1) & (F.col("correct_count") < F.col("total"))).withColumn(
        "miss_rate", F.lit(1.0) - F.col("correct_count") / F.col("total")
    )
    return _worst(rated, "quiz_id", limit).select(
        "quiz_id",
        "place",
        "question_id",
        "question_text",
        "correct_option",
        option_text(F.col("correct_option")).alias("correct_text"),
        "total",
        "correct_count",
        wrong.alias("wrong_count"),
        F.when(cluster, top).alias("top_wrong_option"),
        F.when(cluster, option_text(top)).alias("top_wrong_text"),
        F.when(cluster, count).otherwise(0).alias("top_wrong_count"),
        F.when(cluster, F.coalesce(note, general)).alias("misconception"),
        F.when(cluster & note.isNotNull(), "distractor")
        .when(cluster & general.isNotNull(), "question")
        .alias("misconception_source"),
        "miss_rate",
    )


def missed_shared(sessions: DataFrame, answers: DataFrame, questions: DataFrame, limit: int = 3) -> DataFrame:
    """Z3: the most missed questions per share code over all sessions, from two attempts up.

    Here an option is named only when it also has strictly more wrong answers than the next one, and
    the note is keyed by option index and loses its letter prefix."""
    picks = _picks(answers, sessions, "share_code_id")
    named = F.col("selected_option").isNotNull() & (F.col("wrong") > 0)
    per_option = F.struct(F.col("wrong").alias("n"), F.col("selected_option").alias("letter"))
    totals = picks.groupBy("share_code_id", "question_id").agg(
        F.sum("n").alias("total"),
        F.sum("wrong").alias("wrong_count"),
        F.sort_array(F.collect_list(F.when(named, per_option)), asc=False).alias("_options"),  # at most four
    )
    rated = totals.filter((F.col("wrong_count") > 0) & (F.col("total") >= 2)).withColumn(
        "miss_rate", F.col("wrong_count") / F.col("total")
    )
    worst = _worst(rated, "share_code_id", limit).join(questions.drop("quiz_id"), "question_id", "left")
    top, next_ = F.get("_options", F.lit(0)), F.get("_options", F.lit(1))
    cluster = F.coalesce(
        (top["n"] / F.col("wrong_count") >= CLUSTER) & (top["n"] > F.coalesce(next_["n"], F.lit(0))), F.lit(False)
    )
    letter = top["letter"]
    index = F.array_position(F.array(*[F.lit(o) for o in OPTIONS]), letter) - 1
    raw = F.col("option_feedback")[index.cast("string")]
    note = F.nullif(F.trim(F.regexp_replace(raw, r"^\s*[A-D]\)\s*", "")), F.lit(""))
    return worst.select(
        "share_code_id",
        "place",
        "question_id",
        F.coalesce("question_text", F.lit("(question unavailable)")).alias("question_text"),
        "total",
        "wrong_count",
        F.when(cluster, letter).alias("top_wrong_option"),
        F.when(cluster, option_text(letter)).alias("top_wrong_text"),
        F.when(cluster, top["n"]).otherwise(0).alias("top_wrong_count"),
        "correct_option",
        option_text(F.col("correct_option")).alias("correct_text"),
        F.when(cluster, note).alias("misconception"),
        "miss_rate",
    )


def question_audit(sessions: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Every attempted question of a quiz with picks, correct answers and share correct."""
    picks = _picks(answers, sessions.filter(F.col("status") == "completed"), "quiz_id")
    letter = F.col("selected_option")
    stats = picks.groupBy("quiz_id", "question_id").agg(
        *[
            F.coalesce(F.sum(F.when(letter == o, F.col("n"))), F.lit(0)).alias(f"picks_{o.lower()}")
            for o in OPTIONS[:3]
        ],
        F.sum("n").alias("total_attempted"),
        F.sum("right").alias("correct_count"),
    )
    asked = questions.select("quiz_id", "question_id", "question_text", "correct_option", "sort_order").join(
        stats, ["quiz_id", "question_id"]
    )
    return dense_index(asked).withColumn(
        "percent_correct", half_up(F.col("correct_count") / F.col("total_attempted") * 100).cast("bigint")
    )


def quiz_summary(sessions: DataFrame) -> DataFrame:
    """Per quiz sent, completed, pending, mean score, mastery counts and class band."""
    done = F.col("status") == "completed"
    score = F.coalesce("mastery_percentage", F.lit(0))

    def level(name: str) -> Column:
        return F.count_if(done & (F.col("mastery_level") == name)).alias(f"{name}_count")

    counts = sessions.groupBy("quiz_id").agg(
        F.count("*").alias("sent"),
        F.count_if(done).alias("completed"),
        F.count_if(~done).alias("pending"),
        F.coalesce(half_up(F.avg(F.when(done, score))), F.lit(0)).cast("bigint").alias("avg_score"),
        level("mastered"),
        level("developing"),
        level("needs_practice"),
    )
    return counts.withColumn("band", class_band(F.col("avg_score"), F.col("mastered_count"), F.col("completed")))


def stragglers(sessions: DataFrame) -> DataFrame:
    """Completed sessions below 60 %."""
    return sessions.filter((F.col("status") == "completed") & (F.col("mastery_percentage") < 60)).select(
        "quiz_id", "session_id", "student_name", "mastery_percentage"
    )


def ranked_results(sessions: DataFrame) -> DataFrame:
    """Completed sessions, best first within each quiz."""
    done = sessions.filter(F.col("status") == "completed")
    return done.select(
        "quiz_id", "session_id", "student_name", F.coalesce("mastery_percentage", F.lit(0)).alias("mastery_percentage")
    ).orderBy("quiz_id", F.col("mastery_percentage").desc(), "session_id")


# Z6 ------------------------------------------------------------------------------------

# The adaptive rules.
WINDOW = 3
MIN_ANSWERS = 5
MAX_ANSWERS = 10
START_LEVEL = 3
TOP_LEVEL = 5


def replay_adaptive(answers: DataFrame, order: str = "pos", start: int = START_LEVEL) -> DataFrame:
    """Replay of the difficulty rules over the answers of each session in order.

    Three of three correct raises the level, at most one lowers it. The quiz ends at ten answers, or
    from the fifth on at the top level with three right or the lowest with three wrong. Only the
    first ten answers of a session can matter; the others are cut before the shuffle."""
    first = top_n(answers.select("session_id", order, "is_correct"), ["session_id"], [F.col(order).asc()], MAX_ANSWERS)
    lists = first.groupBy("session_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.col("is_correct").cast("int").alias("ok")))), lambda a: a["ok"]
        ).alias("_a")
    )
    none = F.lit(None).cast("string")
    state = F.struct(
        F.lit(start).alias("level"),
        F.lit(0).alias("answered"),
        F.lit(0).alias("correct"),
        F.lit(None).cast("int").alias("last1"),
        F.lit(None).cast("int").alias("last2"),
        none.alias("reason"),
    )

    def step(s: Column, ok: Column) -> Column:
        hits = ok + s["last1"] + s["last2"]  # NULL until the window is full
        level = (
            F.when(hits == WINDOW, F.least(F.lit(TOP_LEVEL), s["level"] + 1))
            .when(hits <= 1, F.greatest(F.lit(1), s["level"] - 1))
            .otherwise(s["level"])
        )
        answered = s["answered"] + 1
        reason = F.when(answered >= MAX_ANSWERS, "max_questions").when(
            answered >= MIN_ANSWERS,
            F.when((level == TOP_LEVEL) & (hits == WINDOW), "mastery").when((level == 1) & (hits == 0), "floor"),
        )
        after = F.struct(
            level.alias("level"),
            answered.alias("answered"),
            (s["correct"] + ok).alias("correct"),
            ok.alias("last1"),
            s["last1"].alias("last2"),
            reason.alias("reason"),
        )
        return F.when(s["reason"].isNotNull(), s).otherwise(after)

    return lists.select("session_id", F.aggregate("_a", state, step).alias("s")).select(
        "session_id",
        F.col("s.level").alias("final_level"),
        F.col("s.answered").alias("answered"),
        F.col("s.correct").alias("correct"),
        F.col("s.reason").alias("end_reason"),
    )


def valid_questions(questions: DataFrame) -> DataFrame:
    """Usable generated questions: a text, three different options and a key A to C. Long texts
    are cut, the difficulty defaults to 3, and the notes are kept only when both wrong options have
    one of at most 200 characters."""

    def cut(name: str, limit: int) -> Column:
        c = F.col(name)
        return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)

    texts = ["question_text", "option_a", "option_b", "option_c"]
    present = F.lit(True)
    for name in texts:
        present = present & (F.coalesce(F.col(name), F.lit("")) != "")
    kept = questions.filter(present & F.coalesce(F.col("correct_option").isin("A", "B", "C"), F.lit(False))).withColumns(
        {"question_text": cut("question_text", 200), **{n: cut(n, 250) for n in texts[1:]}}
    )
    a, b, c = (F.col(n) for n in texts[1:])
    notes = F.col("distractor_misconceptions")
    wrong = F.filter(F.array(F.lit("A"), F.lit("B"), F.lit("C")), lambda o: o != F.col("correct_option"))
    fine = F.forall(
        wrong, lambda o: F.coalesce((F.trim(notes[o]) != "") & (F.length(notes[o]) <= 200), F.lit(False))
    )
    return kept.filter((a != b) & (b != c) & (a != c)).withColumns(
        {
            "difficulty_level": F.when(F.col("difficulty_level").between(1, 5), F.col("difficulty_level")).otherwise(3),
            "distractor_misconceptions": F.when(
                notes.isNotNull() & fine, F.map_filter(notes, lambda k, v: F.array_contains(wrong, k))
            ),
        }
    )
