"""Chunked windows against plain ones, with chunks and blocks far smaller than the keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.operators import ordered as O
from chalkline.operators.percentiles import exact_percentiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        # one key holds most rows; some keys are NULL
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        data.append((i, key, rng.randrange(400), rng.choice([None, 1, 2, 5])))
    return spark.createDataFrame(data, "id int, key string, at int, v int").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_carry_lag(rows):
    plain = rows.withColumn("prev_v", F.lag("v").over(Window.partitionBy("key").orderBy("at", "id")))
    same(plain, O.carry_lag(rows, ["key"], ["at", "id"], ["v"], F.floor(F.col("at") / 7)))


def test_running_total(rows):
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.withColumn("t", F.sum(F.coalesce("v", F.lit(0))).over(w))
    same(plain, O.running_total(rows, ["key"], ["at", "id"], F.coalesce("v", F.lit(0)), "t", F.floor(F.col("at") / 7)))


def test_number_rows(rows):
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at", "id")).cast("bigint"))
    same(plain, O.number_rows(rows, ["key"], ["at", "id"], "n", F.floor(F.col("at") / 7)))


@pytest.mark.parametrize("before,after", [(3, 0), (0, 4), (2, 2)])
def test_with_neighbours(rows, before, after):
    placed = O.number_rows(rows, ["key"], ["at", "id"], "n", F.floor(F.col("at") / 7))
    frame = lambda *keys: Window.partitionBy(*keys).orderBy("n").rowsBetween(-before, after)
    plain = placed.withColumn("s", F.sum("id").over(frame("key")))
    blocks = O.with_neighbours(placed, ["key"], "n", before, after, size=5)
    cut = blocks.withColumn("s", F.sum("id").over(frame("key", "_block"))).filter("_home").drop("_block", "_home")
    same(plain, cut)


def test_short_keys_are_not_copied_or_joined(spark):
    """A key of one block has no neighbours before it, and one of one chunk nothing to carry."""
    lines = spark.range(4000).select(F.floor(F.col("id") / 4).alias("key"), (F.col("id") % 4 + 1).alias("at"))
    placed = O.number_rows(lines, ["key"], ["at"], "n", O.position_chunk("at"))
    assert placed.count() == 4000 and placed.filter("n <> at").count() == 0
    blocks = O.with_neighbours(placed, ["key"], "n", 5, 4, size=10_000)
    assert blocks.count() == 4000 and blocks.filter("_home").count() == 4000
    numbered = O.number_rows(lines, ["key"], ["at"], "n", O.position_chunk("at"))
    numbered.collect()
    # the joined side has no row, so the adaptive plan ends without a join
    assert "Join" not in numbered._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_top_n_limits_before_the_shuffle(rows):
    top = O.top_n(rows, ["key"], [F.col("at").desc(), F.col("id").asc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.filter("key = 'hot'").count() == 3


def test_sessionize_equals_plain_window(spark):
    from chalkline.operators import windows as W

    rng = random.Random(9)
    data = [(i, rng.choice(["u"] * 5 + ["v"]), rng.randrange(0, 200_000)) for i in range(600)]
    df = spark.createDataFrame(data, "id int, user string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["session_no"] for r in W.sessionize(df, "user", "ts", "id", 30).collect()}
    want, state = {}, {}
    for i, user, s in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        last, no = state.get(user, (None, 0))
        no += last is None or s - last > 1800
        state[user] = (s, no)
        want[i] = no
    assert got == want


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [("a", float(x)) for x in rng.normal(0, 1, 701)] + [("b", 5.0)] * 40 + [("b", 1e9)] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    out = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"m": (0.5, "cont"), "p9": (0.9, "cont"), "d": (0.25, "disc")}).collect()}
    a = np.sort([v for k, v in data if k == "a"])
    assert out["a"]["n"] == 701
    assert np.isclose(out["a"]["m"], np.quantile(a, 0.5)) and np.isclose(out["a"]["p9"], np.quantile(a, 0.9))
    assert out["a"]["d"] == a[int(np.ceil(0.25 * 701)) - 1]
    assert out["b"]["m"] == 5.0 and "c" not in out


def test_percentiles_with_an_outlier(spark):
    from chalkline.operators import percentiles

    data = spark.range(200_000).selectExpr("CAST(id AS DOUBLE) AS v").union(spark.createDataFrame([(1e13,)], "v double"))
    out = exact_percentiles(data, [], "v", {"m": (0.5, "cont"), "p95": (0.95, "disc"), "top": (1.0, "disc")}).first()
    assert (out["n"], out["m"], out["p95"], out["top"]) == (200_001, 100_000.0, 190_000.0, 1e13)
    plan = exact_percentiles(data, [], "v", {"m": (0.5, "disc")})
    cuts = data.agg(F.percentile_approx("v", F.array(*[F.lit(i / percentiles.BINS) for i in range(percentiles.BINS)]), F.lit(8 * percentiles.BINS)).alias("c")).first()["c"]
    assert plan.first()["m"] == 100_000.0
    assert max(b - a for a, b in zip(cuts, cuts[1:]) if b < 1e12) < 1_000  # no bin near the wanted ranks is large


def test_next_question_by_first_gap(spark):
    from chalkline.operators.filters import exclude_answered

    rng = random.Random(4)
    questions = [(q, rng.randrange(4), rng.randrange(1, 6), rng.randrange(9)) for q in range(120)]
    sessions = [(s, rng.randrange(5), rng.randrange(1, 6)) for s in range(80)]
    answers = [(s, rng.randrange(120)) for s, _, _ in sessions for _ in range(rng.randrange(90))]
    got = exclude_answered(
        spark.createDataFrame(sessions, "session_id int, quiz_id int, level int"),
        spark.createDataFrame(questions, "question_id int, quiz_id int, difficulty_level int, sort_order int"),
        spark.createDataFrame(answers, "session_id int, question_id int"),
    )
    want = set()
    for s, z, level in sessions:
        left = [(d != level, o, q, d) for q, y, d, o in questions if y == z and abs(d - level) <= 1 and (s, q) not in set(answers)]
        if left:
            _, _, q, d = min(left)
            want.add((s, z, level, q, d))
    assert {tuple(r) for r in got.collect()} == want


def test_chunks_by_rank(rows, spark):
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at", "id")).cast("bigint"))
    same(plain, O.number_rows(rows, ["key"], ["at", "id"], "n", 40))
    hot = spark.range(100_000).selectExpr("1 AS k", "CAST(id % 50 AS INT) AS at", "id")
    sizes = O._chunked(hot, ["k"], ["at", "id"], 10_000).groupBy("_g").count().collect()
    assert len(sizes) >= 9 and max(r["count"] for r in sizes) <= 12_000
    assert O.number_rows(hot, ["k"], ["at", "id"], "n", 10_000).agg(F.count_distinct("n"), F.max("n")).first()[:] == (100_000, 100_000)


@pytest.mark.parametrize("at", ["1", "CAST(id AS INT)", "CAST(id % 7 AS INT)"])
def test_runs_cut_one_key_whatever_its_order_values(spark, at):
    # one key of a million rows: with one order value, with as many as rows, with a few; and many small keys
    hot = spark.range(1_000_000).selectExpr("1 AS k", f"{at} AS at", "id").union(spark.range(500).selectExpr("CAST(id % 100 AS INT) + 2", "3", "id"))
    sizes = [r["count"] for r in O._chunked(hot, ["k"], ["at", "id"], 50_000).groupBy("_g._chunk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150_000
    got = O.in_order(hot, ["k"], ["at", "id"], 50_000, lag=["id"], number="n")
    most = got.filter("k = 1").agg(F.count_distinct("n"), F.max("n"), F.count("prev_id")).first()
    assert most[:] == (1_000_000, 1_000_000, 999_999)
    assert got.filter("k > 1").agg(F.max("n"), F.count("prev_id")).first()[:] == (5, 400)


def test_one_shuffle_for_window_and_join(rows, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = O.in_order(rows.select("*", F.lit("x").alias("wide")), ["key"], ["at", "id"], F.floor(F.col("at") / 7), ["wide"])
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    full = [line for line in plan.splitlines() if "Exchange hashpartitioning(_g" in line]
    # the rows once, for window and join; the aggregated table of chunks to be summed and, after its window, to be joined
    assert len(full) == 3, plan
    assert plan.count("Exchange hashpartitioning") == 4, plan
