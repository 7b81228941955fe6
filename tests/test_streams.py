"""Streams with a file source: what they emit is what the plain rules say, whatever the micro-batches."""

import random

from pyspark.sql import functions as F

from framewright.operators import sessions
from framewright.streaming import freshness


def streamed(spark, tmp_path, rows, schema, name, query):
    """The rows written as several files, a file a micro-batch, through a streaming query."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-in/part={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in/part=*"))
    q = query(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_buttons(spark, tmp_path):
    got = streamed(spark, tmp_path, [[("a", 0.1, 3), ("a", 0.0, 1)], [("a", 0.2, 2), ("b", 0.0, 4)]], "device string, t double, buttons int", "buttons", freshness.button_events)
    assert sorted(got) == [("a", 0.0, 0, True), ("a", 0.1, 1, True), ("a", 0.2, 0, False), ("b", 0.0, 2, True)]
    rows = spark.createDataFrame([("a", 0.0, 1), ("a", 0.1, 3), ("a", 0.2, 2), ("b", 0.0, 4)], "device string, t double, buttons int")
    assert sorted(tuple(r) for r in sessions.button_edges(rows, "device", ["t"], "buttons", 3).collect()) == sorted(got)


def test_holds_in_streams_and_over_stored_samples(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(160):
        t += rng.choice([0.1, 0.2, 0.2, 0.3])
        rows.append(("s", round(t, 3), i, rng.choice("xxxxxxxxxy"), rng.choice([True] * 9 + [False, None]), rng.choice([True] * 12 + [False])))
    schema = "session string, t double, id long, source string, left boolean, right boolean"
    got = streamed(spark, tmp_path, [rows[:70], rows[70:]], schema, "holds", lambda s: freshness.dual_holds(s, 0.5, 0.25))
    stored = sessions.dual_holds(spark.createDataFrame(rows, schema), "session", 0.5, 0.25)
    assert sorted(got) == sorted(tuple(r) for r in stored.collect()) and len(got) > 2


def test_sessions(spark, tmp_path):
    rows = [("a", 0.0, "end", None), ("a", 1.0, "start", " "), ("a", 2.0, "start", "fold"), ("a", 3.0, "start", "fold"), ("a", 4.0, "end", None), ("a", 5.0, "start", "pour"), ("b", 0.0, "start", None)]
    schema = "source string, t double, kind string, task string"
    got = streamed(spark, tmp_path, [rows[:3], rows[3:]], schema, "marks", freshness.episode_events)
    assert sorted(got) == [("a", 0.0, 0, "refused"), ("a", 1.0, 0, "refused"), ("a", 2.0, 0, "started"), ("a", 3.0, 0, "refused"), ("a", 4.0, 0, "ended"), ("a", 5.0, 1, "started"), ("b", 0.0, 0, "refused")]
    stored = sessions.episode_sessions(spark.createDataFrame(rows, schema)).orderBy("episode").collect()
    assert [tuple(r) for r in stored] == [("a", 0, "fold", 2.0, 4.0), ("a", 1, "pour", 5.0, None)]


def test_aborts(spark, tmp_path):
    rng = random.Random(1)
    limits, counts = {"status_age": 0.1, "action_age": 0.5, "image_age": 0.1}, {"status_age": 3, "action_age": 3, "image_age": 2}
    ages = lambda: [rng.choice([0.01, 0.05, 0.09, high]) for high in (0.2, 0.6, None)]
    rows = [(f"e{e}", float(i), *ages()) for e in range(6) for i in range(40)] + [("calm", float(i), 0.0, 0.0, 0.08 if i > 5 else 0.0) for i in range(12)]
    schema = "session string, t double, status_age double, action_age double, image_age double"
    got = streamed(spark, tmp_path, [[r for r in rows if r[1] < 7], [r for r in rows if r[1] >= 7]], schema, "aborts", lambda s: freshness.abort_verdicts(s, limits, counts, 4, 0.06))
    ticks = spark.createDataFrame(rows, schema).select(F.col("session").alias("episode_index"), F.col("t").alias("frame_index"), *limits)
    stored = sessions.abort_rules(ticks, tuple(limits.values()), tuple(counts.values()), 4, 0.06).select("episode_index", "frame_index", "verdict")
    assert sorted((s, t, v.replace("_age", "")) for s, t, v in got) == sorted(tuple(r) for r in stored.collect())
    assert max(t for s, t, v in got if s == "calm") == 9.0 and any(v == "abort average" for _, _, v in got)


def test_an_idle_key_is_not_forgotten(spark, tmp_path):
    """Key a has no rows for many micro-batches, and its next ones are a day later: numbers, aborts, buttons and last values go on as over stored rows."""
    others = [[(f"x{i}", float(i), "start", "fold")] for i in range(6)]
    schema = "source string, t double, kind string, task string"
    first, later = [("a", 0.0, "start", "fold"), ("a", 1.0, "end", None)], [("a", 86400.0, "start", "pour"), ("a", 86401.0, "end", None)]
    got = streamed(spark, tmp_path, [first, *others, later], schema, "idle_marks", freshness.episode_events)
    assert sorted(r for r in got if r[0] == "a") == [("a", 0.0, 0, "started"), ("a", 1.0, 0, "ended"), ("a", 86400.0, 1, "started"), ("a", 86401.0, 1, "ended")]
    stored = sessions.episode_sessions(spark.createDataFrame(first + later, schema)).orderBy("episode").collect()
    assert [(r.episode, r.start_t, r.end_t) for r in stored] == [(0, 0.0, 1.0), (1, 86400.0, 86401.0)]

    got = streamed(spark, tmp_path, [[("a", 0.0, 5)], [("b", 1.0, 1)], [("b", 2.0, 0)], [("a", 86400.0, 4)]], "device string, t double, buttons int", "idle_buttons", freshness.button_events)
    assert sorted(r for r in got if r[0] == "a") == [("a", 0.0, 0, True), ("a", 0.0, 2, True), ("a", 86400.0, 0, False)]

    limits, counts = {"status_age": 0.1}, {"status_age": 1}
    got = streamed(spark, tmp_path, [[("a", 0.0, 0.5)], [("b", 1.0, 0.0)], [("b", 2.0, 0.0)], [("a", 86400.0, 0.0)]], "session string, t double, status_age double", "idle_aborts", lambda s: freshness.abort_verdicts(s, limits, counts))
    assert [r for r in got if r[0] == "a"] == [("a", 0.0, "abort status_age")]

    got = streamed(spark, tmp_path, [[("a", 0.0, "image")], [("b", 1.0, "image")], [("a", 86400.0, "tick"), ("c", 1.0, "tick")]], "session string, t double, kind string", "idle_inputs", lambda s: freshness.snapshots(s, {"image": 0.1}))
    assert sorted(got) == [("a", 86400.0, "stale image"), ("c", 1.0, "missing image")]


def test_rates(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:03", "a", 3.0), ("2024-01-01 00:00:07", "b", 5.0)]
    schema = "ts string, event_type string, value double"
    later = [("2024-01-01 01:00:00", "a", 0.0)]
    make = lambda s: freshness.windowed_rates(s.withColumn("ts", F.to_timestamp("ts")), "ts", "5 seconds", "1 second")
    got = streamed(spark, tmp_path, [rows, later, later], schema, "rates", make)
    assert sorted((r[1], r[2], r[3]) for r in got) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_lease_fold(spark):
    rows = [(1, 0.0, 1, "claim", "x"), (1, 10.0, 2, "claim", "y"), (1, 400.0, 3, "claim", "y"), (1, 401.0, 4, "skip", "x"), (1, 402.0, 5, "skip", "y"), (1, 403.0, 6, "claim", "x"), (1, 404.0, 7, "skip", "x"), (2, 0.0, 8, "heartbeat", "x"), (2, 1.0, 9, "claim", "x"), (2, 50.0, 10, "heartbeat", "x"), (3, 0.0, 11, "claim", "x"), (3, 1.0, 12, "submit", "x"), (3, 2.0, 13, "claim", "y")]
    out = sessions.lease_fold(spark.createDataFrame(rows, "task_id long, t double, id long, kind string, device string")).orderBy("task_id").collect()
    assert [tuple(r) for r in out] == [(1, "review", None, None, 2, 2), (2, "locked", "x", 350.0, 0, 1), (3, "completed", None, None, 0, 1)]
    assert sessions.lease_fold(spark.createDataFrame([], "task_id long, t double, id long, kind string, device string")).count() == 0
