"""Value tables of the rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chalkline.functions import bands, codes, dates, letters, maths, names, text
from chalkline.operators import brief, filters, gates, quiz, reading, scoring, sets, stats
from chalkline.operators import joins as J


def one(spark, column, **values):
    cells = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cells).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "grade,language,season,l2,value,expected",
    [
        (2, "en", "spring", True, 100.0, (68, 107, True, 50)),
        (1, "en", "spring", True, 0.0, (34, 59, False, 1)),
        (3, "en", "fall", True, 130.0, (53, 107, True, 90)),
        (2, "ur", "winter", True, 40.0, (36, 62, True, 25)),
        (2, "en", "spring", True, 1.0, (68, 107, False, 10)),
        (5, "ur", "spring", True, 60.0, (35, 70, True, 10)),
        (2, "ur", "spring", False, 89.0, (68, 107, True, 50)),
    ],
)
def test_word_norms(spark, grade, language, season, l2, value, expected):
    df = spark.createDataFrame([(value, grade, language)], "wcpm double, grade_level int, language string")
    row = J.threshold_lookup(df, second_language=F.lit(l2), season_col=F.lit(season)).first()
    assert (row["benchmark_min"], row["benchmark_max"], row["on_track_now"], row["percentile_rank"]) == expected


@pytest.mark.parametrize("value,grade,language,expected", [(30.0, 1, "en", (8, 47, True, 75)), (1.0, 1, "ur", (5, 33, False, 25)), (25.0, 9, "en", (20, 60, True, 50))])
def test_letter_norms(spark, value, grade, language, expected):
    df = spark.createDataFrame([(value, grade, language)], "lcpm double, grade_level int, language string")
    row = J.band_lookup(df).first()
    assert (row["benchmark_min"], row["benchmark_max"], row["on_track_now"], row["percentile_rank"]) == expected


@pytest.mark.parametrize("pct,board,grade,passed", [(92, "FBISE", "A+", True), (33, "Punjab_Matric", "E", True), (32, "SSC", "Fail", False), (25, "Cambridge", "G", True), (10, "cie", "U", False), (49, None, "F", False)])
def test_scales(spark, pct, board, grade, passed):
    df = spark.createDataFrame([(pct, board)], "percentage int, board string")
    row = J.grade_scale_join(df).first()
    assert (row["grade"], row["passed"]) == (grade, passed)


@pytest.mark.parametrize("a,b,score", [("Ali", "ali ", 1.0), ("Ali", "Ali Khan", 0.7 + 3 / 8 * 0.3), ("night", "nacht", 0.25), ("", "x", 0.0), ("a", "b", 0.0)])
def test_dice(spark, a, b, score):
    assert one(spark, names.dice(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(score)


@pytest.mark.parametrize("said,status", [("Ghair  Hazir", "absent"), ("jee haazir", "present"), ("gairhazir", "absent"), ("hmm", "unknown"), (None, "unknown"), ("not here", "absent")])
def test_roll_call(spark, said, status):
    assert one(spark, names.normalize_status(F.col("t")), t=said) == status


@pytest.mark.parametrize(
    "raw,cc,valid,normalized,reason",
    [
        ("0791 112-3456", "44", True, "+447911123456", None),
        ("+1 (415) 555-0123", "", True, "+14155550123", None),
        ("12345", "", False, None, "too_short"),
        ("+98 912 345 6789", "", False, None, "blocked"),
        ("abc", "", False, None, "letters"),
        (None, "", False, None, "required"),
        ("1234567890123456", "", False, None, "too_long"),
        ("+0123456789", "", False, None, "invalid"),
    ],
)
def test_phone(spark, raw, cc, valid, normalized, reason):
    got = one(spark, names.normalize_phone(F.col("p"), cc), p=raw)
    assert (got["valid"], got["normalized"], got["reason"]) == (valid, normalized, reason)


def test_roster(spark):
    body = "1. Ali s/o Khan\r\n- Sara, Imran, Jr\n• Zed 0300 123-45678 ;\n\n* +92 300 1234567\nMina D/O Noor"
    rows = names.parse_roster(spark.createDataFrame([(1, body)], "id int, text string")).collect()
    got = [(r["student_name"], r["father_name"], r["parent_phone"]) for r in sorted(rows, key=lambda r: r["line_no"])]
    assert got == [("Ali", "Khan", None), ("Sara", "Imran, Jr", None), ("Zed", None, "030012345678"), ("Mina", "Noor", None)]


@pytest.mark.parametrize(
    "raw,book,issues,code,note",
    [
        ("M-02-NS-03", "2", [], "M-02-NS-03", ""),
        ("U-05-WR-02a", "5", [], "U-05-WR-02a", ""),
        ("U-05-VO-01 [DERIVED]", "5", ["FUSED_ANNOTATION"], "U-05-VO-01", "DERIVED"),
        ("U-05-CO-01", "1", ["GRADE_MISMATCH"], "U-05-CO-01", ""),
        ("students can add", "1", ["MALFORMED"], "students can add", ""),
    ],
)
def test_codes(spark, raw, book, issues, code, note):
    parsed = one(spark, codes.parse_code(F.col("r")), r=raw)
    assert one(spark, codes.validate_code(F.col("r"), F.col("b")), r=raw, b=book) == issues
    assert (parsed["code"], parsed["fused_note"]) == (code, note)


def test_rounding(spark):
    assert one(spark, maths.half_up(F.lit(-2.5))) == -2
    assert one(spark, maths.half_even(F.lit(2.5))) == 2
    assert one(spark, maths.wcpm(F.lit(50), F.lit(0.0))) == 0.0


@pytest.mark.parametrize("day,kind,before", [("2024-01-05", "weekly", "2024-01-04"), ("2024-01-08", "daily", "2024-01-05"), ("2024-01-07", None, "2024-01-05"), ("2024-01-06", None, "2024-01-05")])
def test_calendar(spark, day, kind, before):
    d = F.lit(day).cast("date")
    assert one(spark, dates.brief_kind(d)) == kind
    assert str(one(spark, dates.previous_working_day(d))) == before


def test_working_days(spark):
    lo = dt.date(2024, 1, 1)
    for first in range(8):
        for span in range(20):
            a, b = lo + dt.timedelta(days=first), lo + dt.timedelta(days=first + span)
            want = sum((a + dt.timedelta(days=i)).weekday() < 5 for i in range(span + 1)) or 1
            assert one(spark, dates.working_days(F.lit(str(a)).cast("date"), F.lit(str(b)).cast("date"))) == want
            if span > 8 and first > 2:
                break


@pytest.mark.parametrize(
    "cur,prev,mode,out",
    [(52.4, 48.0, "pct", "▲ 4pt"), (5, 5, "count", "no change"), (12, 30, "count", "▼ 18"), (30, 20, "count", "▲ 50%"), (None, 3, "count", "no earlier data"), (50.4, 50.0, "pct", "no change")],
)
def test_delta(spark, cur, prev, mode, out):
    row = spark.createDataFrame([(None if cur is None else float(cur), float(prev))], "a double, b double")
    assert row.select(brief.delta(F.col("a"), F.col("b"), mode)).first()[0] == out


@pytest.mark.parametrize("said,language", [("", "en"), ("hola niño", "es"), ("यह एक वाक्य है", "hi"), ("میں اسکول جاتا ہوں", "ur"), ("هذا كتاب", "ar"), ("plain words", "en")])
def test_language(spark, said, language):
    assert one(spark, text.detect_language(F.col("t")), t=said) == language


def test_transcript(spark):
    body = "[00:05] Teacher (EN): Open the book\n[00:09] Student 2 (UR): yes\n\nnoise"
    rows = text.parse_lines(spark.createDataFrame([(body,)], "text string")).orderBy("line_no").collect()
    assert [(r["spoken_at"], r["speaker"], r["speaker_type"], r["line_text"]) for r in rows] == [
        ("00:05", "Teacher", "teacher", "Open the book"),
        ("00:09", "Student 2", "student", "yes"),
        ("--:--", "Unknown", "student", "noise"),
    ]
    assert one(spark, text.clean_transcript(F.col("t")), t="[00:01] Teacher (EN): the  cat EN sat") == "the cat sat"
    assert one(spark, text.tokenize(F.col("t")), t="The cat's  ہے!") == ["the", "cats", "ہے"]


def test_feature_phrases(spark):
    scores = text.feature_scores(F.col("t"))
    names_ = list(text.FEATURE_PHRASES)
    assert one(spark, text.best_feature(scores, names_), t="Please make a lesson plan") == "lesson_plan"
    assert one(spark, text.best_feature(scores, names_), t="students read well") is None


def test_chunks(spark):
    body = "a" * 6 + "\n\n" + "b" * 6 + "\n\n" + "c" * 30 + "\n\n" + "d"
    assert one(spark, text.paragraph_chunks(F.col("t"), 14), t=body) == ["a" * 6 + "\n\n" + "b" * 6, "c" * 30, "d"]
    assert one(spark, text.paragraph_chunks(F.col("t"), 14), t=" short ") == [" short "]


def test_letters(spark):
    df = spark.createDataFrame([(1, ["ا", "B", "z"], "Alif, bee!"), (2, [], "x"), (3, ["?"], "")], "id int, letters array<string>, transcript string")
    got = {r["id"]: (r["total"], r["matched"], r["accuracy"]) for r in letters.letters_correct(df).collect()}
    assert got == {1: (3, 2, 67), 2: (0, 0, 0), 3: (1, 0, 0)}


def test_mispronounced(spark):
    az = '{"words":[{"word":"cat","errorType":"Mispronunciation"},{"word":"sat","errorType":"None"}]}'
    other = '{"mispronounced_words":[{"word":"gul","description":""},{"word":"bag","description":"soft g"}]}'
    assert [tuple(x) for x in one(spark, text.mispronounced(F.col("j"), F.lit("en")), j=az)] == [("cat", "Mispronunciation detected")]
    assert [x["issue"] for x in one(spark, text.mispronounced(F.col("j"), F.lit("ur")), j=other)] == ["Mispronunciation detected", "soft g"]


def test_climate(spark):
    items = spark.createDataFrame(
        [([(True, "HIGH", 2), (None, "medium", 0), (False, "high", 3)],)],
        "o array<struct<addressed:boolean,mastery_confidence:string,evidence:int>>",
    )
    got = items.select(bands.objective_coverage(F.col("o"))).first()[0]
    assert tuple(got) == (3, 2, 1, 67)


# scopes ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "scope",
    [None, {}, {"type": "country"}, {"type": "country", "value": {"country_codes": []}}, {"type": "school", "value": {}}, {"type": "combined", "value": {}}, {"type": "nobody"}, {"type": "phone_list", "value": {"phone_numbers": []}}],
)
def test_bad_scope_raises(spark, scope):
    users = filters.scope_columns(spark.createDataFrame([("1", "92", "s", None)], "id string, phone_number string, school_name string, is_test_user boolean"))
    with pytest.raises(ValueError):
        filters.apply_scope(users, scope)


def test_scope_never_shows_test_users(spark):
    users = filters.scope_columns(
        spark.createDataFrame(
            [("1", "921", "A ", None), ("2", "922", None, True), ("3", "943", "b", False)],
            "id string, phone_number string, school_name string, is_test_user boolean",
        )
    )
    assert {r["id"] for r in filters.apply_scope(users, {"type": "all"}).collect()} == {"1", "3"}
    got = filters.apply_scope(users, {"type": "combined", "value": {"country_codes": ["+92"], "phone_numbers": ["943"]}})
    assert {r["id"] for r in got.collect()} == {"1", "3"}


def test_audience_filters(spark):
    users = spark.createDataFrame([], "id string, phone_number string, registration_completed boolean")
    with pytest.raises(ValueError):
        J.audience(users, users, "2024-01-01", "1y")
    with pytest.raises(ValueError):
        J.audience(users, users, "2024-01-01", "7d", "1")


def test_short_search_is_empty(spark):
    users = spark.createDataFrame([("1", "92", True, "Ann", "B", "Ann B")], "id string, phone_number string, registration_completed boolean, first_name string, last_name string, name string")
    assert filters.search_users(users, "an").count() == 0
    assert filters.search_users(users, "ANN").count() == 1


# reading, quiz, scoring -------------------------------------------------------------------


def brute_align(e, a):
    n, m = len(e), len(a)
    dp = [[i + j if i * j == 0 else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            dp[i][j] = dp[i - 1][j - 1] if e[i - 1] == a[j - 1] else 1 + min(dp[i - 1][j - 1], dp[i - 1][j], dp[i][j - 1])
    i, j, c = n, m, dict.fromkeys(("match", "omission", "insertion", "substitution"), 0)
    while i or j:
        if i and j and e[i - 1] == a[j - 1]:
            op = "match"
        elif not j:
            op = "omission"
        elif not i:
            op = "insertion"
        else:
            best = 1 + min(dp[i - 1][j - 1], dp[i - 1][j], dp[i][j - 1])
            op = "substitution" if best == 1 + dp[i - 1][j - 1] else "omission" if best == 1 + dp[i - 1][j] else "insertion"
        c[op] += 1
        i -= op in ("match", "omission", "substitution")
        j -= op in ("match", "insertion", "substitution")
    return c["match"], c["omission"], c["insertion"], c["substitution"], dp[n][m]


def test_align_equals_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        e = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        got = reading.align(e, a)
        assert got[:5] == brute_align(e, a)
        assert [x[3] for x in got[5]] == sorted(x[3] for x in got[5])


def test_fluency(spark):
    df = spark.createDataFrame(
        [
            (1, "sentences", "The cat sat on the mat", "[00:01] Teacher (EN): the cat sit on mat", [("a", 1000, 1500), ("b", 30000, 31000)], 9.0),
            (2, "letters", "A B", "ay", None, None),
            (3, "sentences", "one two", "one two", None, 30.0),
        ],
        "id int, passage_type string, passage_text string, transcript_text string, word_timestamps array<struct<word:string,startMs:bigint,endMs:bigint>>, audio_duration_seconds double",
    )
    got = {r["id"]: r for r in reading.fluency_metrics(df).collect()}
    assert (got[1]["words_correct"], got[1]["time_elapsed"], got[1]["wcpm"], got[1]["word_accuracy"]) == (4, 30, 8.0, 66.7)
    assert [(e["type"], e["position"]) for e in got[1]["errors"]] == [("substitution", 2), ("omission", 4)]
    assert (got[2]["words_correct"], got[2]["metric_type"], got[2]["wcpm"]) == (1, "LCPM", 1.0)
    assert (got[3]["wcpm"], got[3]["word_accuracy"]) == (4.0, 100.0)


def replay(answers):
    level, window = 3, []
    for n, ok in enumerate(answers, 1):
        window = (window + [ok])[-3:]
        if len(window) == 3:
            hits = sum(window)
            level = min(5, level + 1) if hits == 3 else max(1, level - 1) if hits <= 1 else level
        if n >= 10:
            return level, n, "max_questions"
        if n >= 5 and len(window) == 3 and level == 5 and sum(window) == 3:
            return level, n, "mastery"
        if n >= 5 and len(window) == 3 and level == 1 and sum(window) == 0:
            return level, n, "floor"
    return level, len(answers), None


def test_adaptive_replay(spark):
    import random

    rng = random.Random(2)
    runs = {f"s{i}": [rng.random() < rng.choice([0.1, 0.5, 0.95]) for _ in range(rng.randrange(1, 14))] for i in range(60)}
    df = spark.createDataFrame([(s, i, ok) for s, a in runs.items() for i, ok in enumerate(a, 1)], "session_id string, pos int, is_correct boolean")
    got = {r["session_id"]: (r["final_level"], r["answered"], r["end_reason"]) for r in quiz.replay_adaptive(df).collect()}
    assert got == {s: replay(a) for s, a in runs.items()}


def test_valid_questions(spark):
    rows = [
        (1, "q", "a", "b", "c", "A", 9, {"B": "x", "C": "y", "A": "z"}),
        (2, "q" * 201, "a", "b", "c", "C", 2, {"B": "x"}),
        (3, "q", "a", "a", "c", "A", 1, None),
        (4, "", "a", "b", "c", "A", 1, None),
        (5, "q", "a", "b", "c", "D", 1, None),
    ]
    df = spark.createDataFrame(rows, "id int, question_text string, option_a string, option_b string, option_c string, correct_option string, difficulty_level int, distractor_misconceptions map<string,string>")
    got = {r["id"]: r for r in quiz.valid_questions(df).collect()}
    assert set(got) == {1, 2}
    assert got[1]["difficulty_level"] == 3 and got[1]["distractor_misconceptions"] == {"B": "x", "C": "y"}
    assert len(got[2]["question_text"]) == 200 and got[2]["distractor_misconceptions"] is None


def test_wilson_and_wins(spark):
    rows = [("t", "A", 90, 10, 100, 90), ("t", "B", 10, 90, 100, 10), ("one", "X", 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "test_id string, variant_name string, successes bigint, failures bigint, impressions bigint, conversions bigint")
    got = {(r["test_id"], r["variant_name"]): r for r in scoring.ab_variant_stats(df, 2000).collect()}
    assert got["t", "A"]["wilson_lower"] == pytest.approx(0.8256, abs=1e-3) and got["t", "A"]["win_probability"] > 0.99
    assert got["one", "X"]["wilson_upper"] == 0.0 and got["one", "X"]["win_probability"] == 1.0
    again = {(r["test_id"], r["variant_name"]): r["win_probability"] for r in scoring.win_probabilities(df, 2000).collect()}
    assert again["t", "B"] == got["t", "B"]["win_probability"]


def test_win_probability_of_two_equals_the_finite_sum(spark):
    """P(B > A) of two Beta variables with whole parameters is a sum of as many terms as B has successes."""
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def second_wins(a, b, c, d):
        return sum(math.exp(beta(a + i, b + d) - math.log(d + i) - beta(1 + i, d) - beta(a, b)) for i in range(c))

    pairs = [(30, 70, 35, 65), (5, 5, 5, 5), (120, 880, 100, 900), (1, 9, 3, 7), (400, 600, 410, 590)]
    rows = [(f"t{k}", v, s, f) for k, (a, b, c, d) in enumerate(pairs) for v, s, f in (("A", a, b), ("B", c, d))]
    df = spark.createDataFrame(rows, "test_id string, variant_name string, successes bigint, failures bigint")
    got = {(r["test_id"], r["variant_name"]): r["win_probability"] for r in scoring.win_probabilities(df, 10_500).collect()}
    for k, p in enumerate(pairs):
        assert got[f"t{k}", "B"] == pytest.approx(second_wins(*p), abs=0.02)
        assert got[f"t{k}", "A"] + got[f"t{k}", "B"] == pytest.approx(1.0)


def test_win_probability_of_many_variants(spark):
    rows = [("t", f"v{i:05d}", 50, 50) for i in range(3000)] + [("t", "top", 9000, 1000)]
    df = spark.createDataFrame(rows, "test_id string, variant_name string, successes bigint, failures bigint")
    got = {r["variant_name"]: r["win_probability"] for r in scoring.win_probabilities(df, 1000).collect()}
    assert len(got) == 3001 and got["top"] == 1.0 and sum(got.values()) == 1.0


def test_two_discovery_definitions(spark):
    def users_of(ids):
        return spark.createDataFrame([(i, "completed", "lesson_plan", None, dt.datetime(2024, 1, 1)) for i in ids], "user_id int, status string, type string, gamma_url string, created_at timestamp")

    people = spark.createDataFrame([(i, True) for i in range(4)], "id int, registration_completed boolean")
    t = stats.Tables(people, None, None, users_of([0, 1]), users_of([1]), users_of([]), users_of([3]))
    assert stats.feature_discovery(t, "live").first()[0] == 25.0
    assert stats.feature_discovery(t, "snapshot").first()[0] == 50.0
    with pytest.raises(ValueError):
        stats.feature_discovery(t, "other")


def test_retention_day_gap(spark):
    """An event on the next calendar day but within 24 hours counts neither as day 0 nor as week 1."""
    start = dt.datetime(2024, 1, 3, 20, 0)
    users = spark.createDataFrame([(1, start), (2, start)], "id int, created_at timestamp")
    activity = spark.createDataFrame([(1, start + dt.timedelta(hours=10)), (2, start + dt.timedelta(hours=24))], "user_id int, at timestamp")
    row = stats.retention_cohorts(users, activity, "2024-02-01").first()
    assert (row["cohort_size"], row["day0_activation_pct"], row["week1_users"]) == (2, 0.0, 1)
    assert str(row["cohort_week"]) == "2024-01-01" and row["has_week4_data"] and not row["has_week5_8_data"]


def test_word_frequency_rules(spark):
    df = spark.createDataFrame([("The CAT, the cat; 123 ab hai é-mail café",)], "text string")
    got = {r["word"]: r["count"] for r in sets.word_frequency(df).collect()}
    assert got == {"cat": 2, "mail": 1, "caf": 1}


def test_qa_minutes(spark):
    def lesson(i, step):
        return (i, '{"warmUp":"a warm up that is long enough","steps":[{"title":"t","text":"%s"}],"exitTicket":"an exit ticket that is long enough","duration_min":40}' % step)

    rows = [lesson(1, "5 min 10 min 15 min 5 min 5 min, total 40 min"), lesson(2, "5 min"), lesson(3, "TBD 30 min")]
    df = spark.createDataFrame(rows, "lesson_id int, j string").select(
        "lesson_id", F.from_json("j", gates.LESSON_BODY).alias("body"), F.lit(None).cast("array<int>").alias("pages"),
        F.lit(None).cast("array<string>").alias("slo_codes"), F.lit(False).alias("has_segment"),
    )
    checks = gates.qa_checks(df)
    got = {(r["lesson_id"], r["check_id"]): r["passed"] for r in checks.collect()}
    assert got[1, "S2"] and not got[2, "S2"] and got[3, "S2"]
    assert got[1, "H1"] and not got[3, "H1"] and (1, "H5") not in got
    assert {r["lesson_id"]: r["hard_pass"] for r in gates.qa_summary(checks).collect()} == {1: True, 2: False, 3: False}


def test_interval_join_equals_row_by_row(spark):
    import random

    rng = random.Random(12)
    base = dt.datetime(2024, 3, 1)
    starts = {u: base + dt.timedelta(minutes=rng.randrange(5000)) for u in range(12)}
    events = [(rng.randrange(14), base + dt.timedelta(minutes=rng.randrange(-2000, 60_000))) for _ in range(150)]
    # events exactly on bucket borders
    events += [(u, s + dt.timedelta(days=d)) for u, s in list(starts.items())[:4] for d in (1, 8)]
    buckets = [("a", 1, 8), ("b", 8, 9), ("c", 15, 30)]
    out = J.interval_join(
        spark.createDataFrame(list(starts.items()), "user_id int, started_at timestamp"),
        spark.createDataFrame(events, "user_id int, at timestamp"),
        buckets,
    )
    for r in out.collect():
        s = starts[r["user_id"]]
        mine = [t for u, t in events if u == r["user_id"]]
        assert r["day0"] == any(t.date() == s.date() for t in mine)
        for name, lo, hi in buckets:
            assert r[name] == any(s + dt.timedelta(days=lo) <= t < s + dt.timedelta(days=hi) for t in mine)


def test_wide_spaces_and_urdu_search(spark):
    from chalkline.functions.text import clean_transcript, tokenize
    from chalkline.operators.vectors import weighted_index, weighted_search

    df = spark.createDataFrame([("foo bar", "[01:02]  a 　b "), ("کتاب x", "﻿EN y")], "a string, b string")
    got = df.select(tokenize(F.col("a")).alias("a"), clean_transcript(F.col("b")).alias("b")).collect()
    assert [list(r.a) for r in got] == [["foo", "bar"], ["کتاب", "x"]] and [r.b for r in got] == ["a b", "y"]
    catalog = spark.createDataFrame([(1, "3", "کتاب ریاضی"), (2, "4", "maths")], "id int, grade string, topic string")
    index = weighted_index(catalog, {"grade": "A", "topic": "B"})
    assert [r.id for r in weighted_search(index, "ریاضی").collect()] == [1]


def test_benchmark_table_function_is_sql(spark):
    from chalkline.functions import norms
    from chalkline.functions.named import register_functions

    register_functions(spark)
    grade, lang, season = 1, "en", "spring"
    cuts = norms.WORD_NORMS[grade, lang, season]
    rates = [(0, 0.2), (1, float(cuts[0])), (2, cuts[2] - 0.5), (3, cuts[4] + 100.0), (4, cuts[1] - 0.51), (5, None)]
    df = spark.createDataFrame([(i, r, grade) for i, r in rates], "i int, r double, g int")
    call = f"SELECT i, b.* FROM {{df}} d, LATERAL check_benchmark_status(d.r, d.g, '{lang}', true, '{season}') b"
    got = spark.sql(call, df=df)
    low, high = cuts[1], cuts[3]
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, low, high, False, 1), (1, low, high, False, 10), (2, low, high, True, 50), (3, low, high, True, 90), (4, low, high, False, 10), (5, low, high, None, None),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "UDTF" not in plan
    other = spark.sql("SELECT * FROM check_benchmark_status(40D, 99, 'ur', true, 'none') UNION ALL SELECT * FROM check_benchmark_status(40D, 99, 'ur', false, NULL)")
    assert [tuple(r) for r in other.collect()] == [(35, 70, True, 10), (50, 100, False, 10)]


def repeats(df, name: str) -> int:
    """How often the optimized plan calls a function."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}(")


def test_phone_steps_run_once(spark):
    rows = spark.createDataFrame([("0300 1234567",), (None,)], "raw string")
    out = rows.select(names.normalize_phone(F.col("raw"), "+44").alias("p")).select("p.*")
    assert [tuple(r) for r in out.collect()] == [(True, "+443001234567", None), (False, None, "required")]
    assert repeats(out, "regexp_replace") == 2


def test_indicators_are_parsed_once(spark):
    from chalkline.operators import coaching

    doc = '{"areas": {"x": {"indicators": [{"id": "1", "name": "I 1", "score": 2}, {"id": "2", "name": "I 2", "score": 1}]}}}'
    rows = spark.createDataFrame([("a", doc), ("b", "{}"), ("c", None)], "session_id string, analysis_data string")
    built = rows.withColumn("analysis_data", F.reverse(F.reverse("analysis_data")))
    focus = coaching.focus_indicator(built)
    assert [tuple(r) for r in focus.collect()] == [("a", "I 2", 1.0, 3.0, "x", "2")]
    named = coaching.focus_names(built, {"weakest": "weakest", "last": lambda items: F.element_at(items, -1)})
    assert [tuple(r) for r in named.collect()] == [("a", "I 2", "I 2")]
    for df in (focus, named):
        assert repeats(df, "reverse") == 2


def test_deliveries_without_a_session_do_not_meet_as_one_key(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [(day, 1, "m", day, "accepted", "s1"), (day, 1, "m", None, "ignored", None), (day, 1, "m", day, "declined", "s9")]
    sent = spark.createDataFrame(rows, "delivered_at timestamp, grade int, subject string, quiz_offered_at timestamp, quiz_response string, quiz_session_id string")
    sessions = spark.createDataFrame([("s1", "completed"), (None, "completed")], "session_id string, status string")
    out = scoring.video_quiz_popularity(sent, sessions)
    assert [tuple(r)[3:] for r in out.collect()] == [(3, 2, 1, 1, 1, 1, 50.0)]
    plan = out._jdf.queryExecution().optimizedPlan()
    join = next(line for line in plan.toString().splitlines() if "Join LeftOuter" in line)
    below = plan.toString().split(join)[1]
    assert "isnotnull(quiz_session_id" in below
