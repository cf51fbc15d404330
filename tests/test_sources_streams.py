"""Sources, sinks and streams, with files written by the tests."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chalkline.operators import gates
from chalkline.operators.windows import sessionize, sessions
from chalkline.sources import corpora, parts, sinks
from chalkline.sources.features import catalog_features, detect_features
from chalkline.sources.tables import load
from chalkline.streaming import run
from chalkline.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# S1 - S4 -----------------------------------------------------------------------------


def test_load_refuses_drift(spark, tmp_path):
    good = spark.createDataFrame([(1, "a", 2, 3.0, "s")], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    good.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "good"))
    assert load(spark, "customer", str(tmp_path / "good")).columns == good.columns
    good.withColumn("c_acctbal", F.lit("x")).drop("c_name").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="c_acctbal.*|c_name"):
        load(spark, "customer", str(tmp_path / "bad"))
    with pytest.raises(KeyError):
        load(spark, "unheard_of", str(tmp_path / "good"))


def test_segments_from_files(spark, tmp_path):
    seg = lambda i: {"segment_index": i, "topic": f"t{i}", "slo_codes": ["M-02-NS-01"]}
    (tmp_path / "grade_2_math_full_segments.json").write_text(json.dumps([seg(1), seg(2)], indent=1))
    (tmp_path / "grade_one_big_words_full_segments.json").write_text(json.dumps({"segments": [seg(3)]}))
    (tmp_path / "grade_3_broken_full_segments.json").write_text("{not json")
    (tmp_path / "other.json").write_text("[]")
    rows = corpora.read_segments(spark, str(tmp_path)).orderBy("segment_index").collect()
    assert [(r["book_id"], r["grade"], r["subject"], r["position"], r["topic"]) for r in rows] == [
        ("grade_2_math", "2", "math", 0, "t1"),
        ("grade_2_math", "2", "math", 1, "t2"),
        ("grade_one_big_words", "one", "big words", 0, "t3"),
    ]


def test_ledger(spark, tmp_path):
    lines = ['{"ts":"1","stage":"a","unit":"u","artifact":"f"}', "", "oops", '{"ts":"1","stage":"a"}', '{"ts":null,"stage":"","unit":"u","artifact":"f"}']
    (tmp_path / "ledger.jsonl").write_text("\n".join(lines))
    counts = corpora.ledger_counts(corpora.read_ledger(spark, str(tmp_path / "ledger.jsonl"))).first()
    assert (counts["stamped"], counts["malformed"]) == (2, 2)
    with pytest.raises(ValueError):
        corpora.read_ledger(spark, str(tmp_path / "_ledger.jsonl"))


def test_features(spark):
    found = detect_features({"users": ["id", "region"], "quiz_sessions": ["user_id", "created_at"], "coaching_sessions": ["observation_type", "observer_user_id"]})
    assert found.unit_column("school_name") == "region" and found.feature_tables() == ["quiz_sessions"]
    assert [s[0] for s in found.active_sources()] == ["quiz_sessions"] and found.observations and not found.debriefs
    assert detect_features({}).unit_column("region") is None
    spark.createDataFrame([(1,)], "user_id int").createOrReplaceTempView("lp_feedback")
    assert catalog_features(spark).ratings


# S5 - S9 ---------------------------------------------------------------------------------


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "visits")
    rows = lambda *x: spark.createDataFrame([(k, v, at(v)) for k, v in x], "session_id string, v int, created_at timestamp")
    for batch in (rows(("a", 2), ("a", 1), ("b", 5)), rows(("a", 0), ("c", 7)), rows(("a", 0), ("c", 7))):
        sinks.append_once(batch, path, "session_id", ["created_at"])
    assert sorted((r["session_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5), ("c", 7)]


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path)
    one = spark.range(3)
    sinks.snapshot(one, folder, "v", "2024-01-01 00:00:00")
    sinks.snapshot(spark.range(5), folder, "v", "2024-01-01 00:10:00")
    sinks.snapshot(spark.range(4), folder, "v", "2024-01-01 00:10:00")
    latest = sinks.read_snapshot(spark, folder, "v")
    assert latest.count() == 4
    status = sinks.snapshot_status({"v": latest}, "2024-01-01 00:14:59").first()
    assert (status["row_count"], status["minutes_since_refresh"], status["needs_refresh"]) == (4, 4, False)
    assert sinks.snapshot_status({"v": latest}, "2024-01-01 00:15:00").first()["needs_refresh"]

    def broken():
        raise RuntimeError("no table")

    report = sinks.refresh_all({"bad": broken, "w": lambda: spark.range(2)}, folder, "2024-01-02 00:00:00")
    assert [r["error"] for r in report] == ["no table", None] and sinks.read_snapshot(spark, folder, "w").count() == 2


def test_publish(spark, tmp_path):
    panel = spark.createDataFrame([("x", 1, 2.5), ("y", 3, None)], "unit string, n int, pct double")
    rows = sinks.metric_rows(panel, "units", ["unit"], "daily", "2024-01-05")
    sinks.publish_metrics(rows, str(tmp_path))
    sinks.publish_metrics(rows, str(tmp_path))
    back = spark.read.json(str(tmp_path / "metrics"))
    assert back.count() == 4 and (tmp_path / "metrics" / "kind=daily" / "day=2024-01-05").is_dir()
    assert spark.read.json(str(tmp_path / "manifest")).first()["values"] == 4


def test_project_check(spark, tmp_path):
    files = [
        "01_page_truth/grade_2_math/pg_001.json", "01_page_truth/grade_2_math/pg_7.json", "01_page_truth/Book/x.txt", "02_segmentation/grade_2_math_full_segments.json",
        "02_segmentation/grade_9_none_full_segments.json", "03_enrichment/grade_2_math/grade_2_math_ch1_seg1.json", "03_enrichment/grade_2_math/odd.json",
        "04_lesson_plans/grade_2_math_ch1_seg1/_slide_script.json", "04_lesson_plans/grade_2_math_ch1_seg1.pdf", "05_voicenotes/grade_2_math_ch1_seg1.mp3",
        "05_voicenotes/grade_2_math_ch1_seg1.ogg", "05_voicenotes/lost.mp3",
    ]
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    assert listed.count() == len(files)
    got = {(r["problem"], r["item"]) for r in gates.project_problems(listed).collect()}
    assert got == {
        ("book name", "Book"), ("page name", "grade_2_math/pg_7.json"), ("book without pages", "Book"), ("segmentation of unknown book", "grade_9_none"),
        ("lesson body name", "grade_2_math/odd.json"), ("audio without lesson", "lost"), ("two audio formats", "grade_2_math_ch1_seg1"),
    }
    ledger = spark.createDataFrame([(False,), (False,), (True,)], "malformed boolean")
    stats = gates.project_stats(listed, ledger).first()
    assert (stats["pages"], stats["voicenotes"], stats["produced"], stats["stamped"], stats["stamp_coverage"], stats["low_coverage"]) == (2, 2, 6, 2, 33.0, True)


# ST ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """Events in ten files by time, so that a stream sees them in ten batches."""
    import random

    rng = random.Random(11)
    rows = sorted((rng.randrange(0, 20_000), rng.randrange(6), rng.choice(["view", "click"])) for _ in range(600))
    folder = tmp_path_factory.mktemp("events")
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    made = [(i, at(m), u, k, 1.0, "{}") for i, (m, u, k) in enumerate(rows)]
    for b in range(10):
        part = spark.createDataFrame(made[b * 60 : (b + 1) * 60], schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        part.coalesce(1).write.parquet(str(folder / f"tmp{b}"))
        written = next((folder / f"tmp{b}").glob("part-*.parquet"))
        (folder / f"events{b}.parquet").write_bytes(written.read_bytes())
    import os
    import time

    for b in range(10):
        os.utime(folder / f"events{b}.parquet", (time.time() - 1000 + b * 10,) * 2)
    batch = spark.createDataFrame(made, schema)
    return str(folder), batch


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_stream_sessions_equal_batch_on_closed_windows(spark, event_files):
    folder, batch = event_files
    live = run.drain(ST.stream_sessions(ST.read_stream(spark, "events", folder, 1), "user_id", "ts"), "sessions")
    whole = sessions(sessionize(batch, "user_id", "ts", "event_id", 30))
    mark = batch.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    closed = whole.filter(F.col("ended_at") + F.expr("INTERVAL 30 MINUTE") <= F.lit(mark))
    columns = ("user_id", "started_at", "ended_at", "message_count")
    assert pairs(live, *columns) == pairs(closed, *columns) and closed.count() > 20


def test_stream_counters_equal_batch(spark, event_files):
    folder, batch = event_files
    roles = lambda df: df.select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "view", "assistant").otherwise("user").alias("role"))
    live = run.drain_updates(ST.stream_counters(roles(ST.read_stream(spark, "events", folder, 3))), "counters", ["session_id"])
    whole = roles(batch).groupBy("session_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("turn_count"))
    assert pairs(live, "session_id", "message_count", "turn_count") == pairs(whole, "session_id", "message_count", "turn_count")


def test_stream_visits_keep_first(spark, event_files):
    folder, batch = event_files
    visits = ST.read_stream(spark, "events", folder, 2).select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"))
    live = run.drain(ST.stream_visits(visits, delay="30 days"), "visits")
    assert pairs(live, "session_id") == [(i,) for i in range(6)]


def test_stream_rate_equals_batch(spark, event_files):
    folder, batch = event_files
    live = run.drain(ST.stream_rate(ST.read_stream(spark, "events", folder, 1), "ts", "1 hour"), "rate")
    mark = batch.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    whole = batch.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("count"))
    closed = whole.filter((F.col("date") + 1).cast("timestamp") <= F.lit(mark))
    assert pairs(live, "date", "count") == pairs(closed, "date", "count") and closed.count() > 5


def write_batches(spark, folder, schema, batches):
    import os
    import time

    for b, rows in enumerate(batches):
        out = folder / f"t{b}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(out))
        target = folder / f"in{b}.parquet"
        target.write_bytes(next(out.glob("part-*.parquet")).read_bytes())
        os.utime(target, (time.time() - 500 + 10 * b,) * 2)
    return spark.readStream.schema(schema).option("pathGlobFilter", "in*.parquet").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stale_sessions_over_batches(spark, tmp_path):
    h = 60
    batches = [
        [("a", at(0), "session"), ("b", at(0), "session"), ("x", at(10), "chat")],
        [("b", at(3 * h), "chat"), ("c", at(4 * h), "session")],
        [("c", at(5 * h), "session"), ("tick", at(6 * h), "chat")],
        [("tick", at(20 * h), "chat")],
        [("tick", at(30 * h), "chat")],
    ]
    stream = write_batches(spark, tmp_path, "session_id string, ts timestamp, kind string", batches)
    out = pairs(run.drain(ST.stream_stale(stream, delay="0 seconds"), "stale"), "session_id", "action", "due_at")
    assert [x for x in out if x[0] == "a"] == [("a", "auto_complete", at(12 * h)), ("a", "reminder", at(2 * h))]
    b = [x for x in out if x[0] == "b"]
    assert ("b", "auto_complete", at(12 * h)) in b and sum(x[1] == "reminder" for x in b) == 1
    assert [x for x in out if x[0] == "c"] == [("c", "auto_complete", at(17 * h))]
    assert not [x for x in out if x[0] in ("x", "tick")]


def test_expiry_over_batches(spark, tmp_path):
    h = 60
    batches = [
        [("q", at(0), True), ("q", at(5), False)],
        [("q", at(2 * h), True), ("z", at(23 * h), None)],
        [("z", at(25 * h), True)],
        [("w", at(60 * h), None)],
    ]
    stream = write_batches(spark, tmp_path, "session_id string, ts timestamp, is_correct boolean", batches)
    out = pairs(run.drain(ST.stream_expiry(stream, delay="0 seconds"), "expiry"), "session_id", "action", "due_at", "mastery")
    assert ("q", "expired", at(24 * h), 67) in out and ("z", "expired", at(47 * h), 100) in out
    assert sum(x[:2] == ("q", "reminder") for x in out) == 1


def test_steps_make_no_frame_without_rows():
    """Most steps have nothing to say; an empty typed frame cost more than all else that they do."""
    names = ["session_id", "action", "due_us", "mastery"]
    assert list(ST._frames([], names)) == []
    (frame,) = ST._frames([("q", "reminder", 5, None), ("q", "expired", 9, 67)], names)
    assert frame.to_numpy().tolist() == [["q", "reminder", 5, None], ["q", "expired", 9, 67]]


def state_keys(spark, stream, folder):
    """Run to the end and return the keys that are still in the state store."""
    started = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    keys = spark.read.format("statestore").load(f"{folder}/check").select("key.*").collect()
    return sorted(r[0] for r in keys), pairs(spark.read.schema(stream.schema).parquet(f"{folder}/rows"), "session_id", "action")


def test_chat_only_keys_leave_the_state(spark, tmp_path):
    h = 60
    batches = [
        [("a", at(0), "session"), *[(f"x{i}", at(i), "chat") for i in range(30)]],
        [("late", at(5 * h), "session")],
        [("tick", at(6 * h), "chat")],
        [("tick", at(7 * h), "chat")],
    ]
    stream = write_batches(spark, tmp_path, "session_id string, ts timestamp, kind string", batches)
    keys, out = state_keys(spark, ST.stream_stale(stream, delay="0 seconds"), str(tmp_path / "state"))
    assert keys == ["a", "late", "tick"] and ("a", "reminder") in out


def test_a_session_expires_once(spark, tmp_path):
    h, d = 60, 24 * 60
    batches = [
        [("q", at(0), True), ("r", at(0), True)],
        [("tick", at(25 * h), None)],
        [("tick1", at(25 * h + 30), None)],  # with this batch the watermark is past both expiries
        [("q", at(26 * h), True)],
        [("tick2", at(3 * d), None)],
        [("q", at(3 * d + h), False)],
        [("tick3", at(9 * d), None)],
        [("tick4", at(11 * d + 2 * h), None)],
        [("tick5", at(11 * d + 3 * h), None)],
    ]
    stream = write_batches(spark, tmp_path, "session_id string, ts timestamp, is_correct boolean", batches)
    keys, out = state_keys(spark, ST.stream_expiry(stream, delay="0 seconds"), str(tmp_path / "state"))
    assert out.count(("q", "expired")) == 1 and out.count(("r", "expired")) == 1 and out.count(("q", "reminder")) == 1
    assert "r" not in keys and "q" not in keys and "tick5" in keys


def test_nudge(spark, tmp_path):
    plans = tmp_path / "p"
    coached = tmp_path / "c"
    plans.mkdir(), coached.mkdir()
    p = write_batches(spark, plans, "id string, user_id string, created_at timestamp", [[("1", "u", at(0)), ("2", "v", at(0)), ("3", "w", at(0))], [("9", "x", at(2000))]])
    c = write_batches(spark, coached, "user_id string, created_at timestamp", [[("u", at(30)), ("v", at(150)), ("w", at(-10))], [("y", at(2000))]])
    assert pairs(run.drain(ST.stream_nudge(p, c), "nudge"), "plan_id") == [("2",), ("3",)]


def test_snapshot_stream_reports(spark, event_files, tmp_path):
    folder, _ = event_files
    reports = []
    started = ST.stream_snapshot(
        ST.read_stream(spark, "events", folder), {"n": lambda: spark.range(4)}, str(tmp_path / "s"), str(tmp_path / "c"), lambda: "2024-01-01 00:00:00", reports.append, every=None
    )
    started.awaitTermination()
    assert [r["view"] for r in reports[0]] == ["n"] and sinks.read_snapshot(spark, str(tmp_path / "s"), "n").count() == 4


def test_time_filters_reach_the_scan(spark):
    from chalkline.operators.filters import in_days

    events = load(spark, "events", "/root/testdata/sf0.001/events.parquet")
    plan = in_days(events, "ts", "2024-01-05", "2024-01-06", "Asia/Karachi").select("event_id", "d")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "props" not in plan


def _files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def _table(spark, folder):
    return sorted((tuple(r) for r in parts.read_parts(spark, str(folder)).collect()), key=str)


def test_parts_are_replaced_together(spark, tmp_path):
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a/b:c", 4)], "k string, v int")
    parts.replace_parts(one, str(tmp_path), F.col("k"), tag=1)
    assert sorted(_table(spark, tmp_path), key=lambda r: r[1]) == [("a", 1), ("b", 2), (None, 3), ("a/b:c", 4)]
    two = spark.createDataFrame([("a", 10), ("a", 11)], "k string, v int")
    before = _files(tmp_path)
    parts.replace_parts(two, str(tmp_path), F.col("k"), gone=["2D", "-"], tag=2)
    assert {r[1] for r in _table(spark, tmp_path)} == {10, 11, 2, 4}
    assert before <= _files(tmp_path)  # the commit before stays for its readers
    assert parts.pointer(spark, str(tmp_path))["tag"] == 2
    parts.replace_parts(two.limit(0), str(tmp_path), F.col("k"), gone=None, keep=1)
    assert _table(spark, tmp_path) == [] and _files(tmp_path) == set()


def test_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    parts.replace_parts(rows, str(tmp_path), F.col("k"), keep=1)
    held = _files(tmp_path)

    def dies(line):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the data, before the pointer
        m.setattr(parts.json, "dumps", dies)
        with pytest.raises(RuntimeError, match="lost"):
            parts.replace_parts(rows.withColumn("v", F.lit(9)), str(tmp_path), F.col("k"))
    assert _table(spark, tmp_path) == [("a", 1), ("b", 2)] and held < _files(tmp_path)
    (tmp_path / "pointer" / "n=2" / "_temporary").mkdir(parents=True)  # a pointer that was not finished
    assert _table(spark, tmp_path) == [("a", 1), ("b", 2)]
    parts.replace_parts(rows.withColumn("v", F.lit(5)), str(tmp_path), F.col("k"), gone=None, keep=1)
    assert _table(spark, tmp_path) == [("a", 5), ("b", 5)] and not held & _files(tmp_path)
    with pytest.raises(FileNotFoundError):
        parts.read_parts(spark, str(tmp_path / "none"))


def test_purge_deletes_from_touched_months_only(spark, tmp_path):
    rows = [
        (1, "completed", "2024-01-10"), (2, "queued", "2024-01-11"), (3, "failed", "2024-02-01"),
        (4, "completed", "2024-03-20"), (5, "completed", None), (6, None, "2024-01-01"),
    ]
    jobs = spark.createDataFrame(rows, "id int, status string, completed_at string").withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    sinks.store_jobs(jobs, str(tmp_path))
    march = {p for p in _files(tmp_path) if f"_part={'2024-03'.encode().hex().upper()}" in p}
    assert sinks.purge_table(spark, str(tmp_path), "2024-04-01 00:00:00") == 2
    assert [r[0] for r in _table(spark, tmp_path)] == [2, 4, 5, 6]
    # the deleted rows are in no file, and the untouched month was not written again
    on_disk = {r["id"] for f in _files(tmp_path) for r in spark.read.parquet(str(tmp_path / f)).collect()}
    assert on_disk == {2, 4, 5, 6} and march and march <= _files(tmp_path)
    held = _files(tmp_path)
    assert sinks.purge_table(spark, str(tmp_path), "2024-04-01 00:00:00") == 0 and _files(tmp_path) == held


def test_refresh_replaces_listed_days(spark, tmp_path):
    asked = []

    def daily(table):
        def build(days):
            asked.append(list(days))
            return spark.createDataFrame(table, "d string, n int").groupBy(F.to_date("d").alias("d")).agg(F.sum("n").alias("n"))

        return build

    rows = [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)]
    sinks.refresh_days(str(tmp_path), "v", daily(rows), "d", ["2024-01-01", "2024-01-02", "2024-01-03"], "2024-01-04 00:00:00")
    changed = [("2024-01-01", 100), ("2024-01-02", 20), ("2024-01-02", 5)]
    sinks.refresh_days(str(tmp_path), "v", daily(changed), "d", ["2024-01-02", "2024-01-03"], "2024-01-05 00:00:00")
    got = sorted((str(r["d"]), r["n"]) for r in sinks.read_snapshot(spark, str(tmp_path), "v").collect())
    assert got == [("2024-01-01", 1), ("2024-01-02", 25)] and asked[1] == ["2024-01-02", "2024-01-03"]


def test_counts_are_merged_once(spark, event_files, tmp_path):
    folder, batch = event_files
    roles = lambda df: df.select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "view", "assistant").otherwise("user").alias("role"))
    rows, table = roles(ST.read_stream(spark, "events", folder, 1)), str(tmp_path / "t")
    started = ST.stream_merge(rows, ST.stream_counters, ["session_id"], table, str(tmp_path / "c"), every=None, fold_after=2)
    started.awaitTermination()
    columns = ("session_id", "message_count", "turn_count")
    whole = pairs(ST.stream_counters(roles(batch)), *columns)
    assert pairs(ST.read_counts(spark, table, ["session_id"]), *columns) == whole
    now = parts.pointer(spark, table)
    assert len(started.recentProgress) > 2 and len(now["parts"]) <= 2
    assert all(not p.get("stateOperators") for p in started.recentProgress)  # the stream itself holds nothing
    # a batch that is replayed changes nothing, the next one is added
    again = ST.stream_counters(roles(batch))
    assert not ST.merge_counts(again, now["tag"], table, ["session_id"]) and parts.pointer(spark, table) == now
    assert ST.merge_counts(again, now["tag"] + 1, table, ["session_id"])
    twice = pairs(ST.read_counts(spark, table, ["session_id"]), *columns)
    assert [(k, 2 * m, 2 * t) for k, m, t in whole] == twice


def test_daily_stream_reads_touched_days(spark, event_files, tmp_path):
    folder, batch = event_files
    asked = []

    def daily(days):
        asked.append(days)
        return batch.filter(F.to_date("ts").cast("string").isin(days)).groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))

    changes = ST.read_stream(spark, "events", folder)
    args = ({"v": ("d", daily)}, str(tmp_path / "s"))
    ST.stream_daily(changes, *args, str(tmp_path / "c"), lambda: "2024-02-01 00:00:00", every=None).awaitTermination()
    whole = pairs(batch.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")), "d", "n")
    assert pairs(sinks.read_snapshot(spark, str(tmp_path / "s"), "v"), "d", "n") == whole
    one = changes.filter(F.to_date("ts") == F.lit(whole[0][0]).cast("date"))
    ST.stream_daily(one, *args, str(tmp_path / "c2"), lambda: "2024-02-01 00:00:00", every=None).awaitTermination()
    assert asked[-1] == [str(whole[0][0])] and pairs(sinks.read_snapshot(spark, str(tmp_path / "s"), "v"), "d", "n") == whole
