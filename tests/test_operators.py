"""Small cases with known answers."""

import time

import pytest
from pyspark.sql import functions as F

from framewright.functions import vectors as V
from framewright.operators import labels, quality, windows
from framewright.plans import transforms
from framewright.streaming.freshness import edges, hold_step


def test_transition_starts_keep_the_last(spark):
    rows = labels.transition_starts(spark.createDataFrame([(0, 22), (1, 19), (2, 20), (3, 23)], "episode_index long, length long")).orderBy("episode_index", "start_frame").collect()
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(0, 0, 20, False), (0, 2, -1, True), (2, 0, -1, True), (3, 0, 20, False), (3, 2, 22, False), (3, 3, -1, True)]


def test_progress_of_flat_and_finished_episodes(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, -1), (1, 2, 2)], "episode_index long, frame_index long, raw_state int")
    got = [r.progress for r in labels.progress(df).orderBy("episode_index", "frame_index").collect()]
    assert got == pytest.approx([0, 0, 0.99, 0, 1.0])


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([float("nan"), 0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.is_valid_vector("v", 3)).collect()] == [True, False, False]
    assert df.select(V.pad("v", 5)).first()[0] == [1, 2, 3, 0, 0]
    assert df.select(V.pad("v", 2)).first()[0] == [1, 2, 3]
    assert [r[0] for r in spark.createDataFrame([(-1.5,), (-1.0,), (0.0,), (1.0,), (9.0,), (float("nan"),)], "x double").select(V.bin256("x")).collect()] == [-1, 0, 128, 255, 255, 255]
    assert V.bool_mask(2, -2, 0, 2) == [True, True, False, False, True, True]


def test_runs_and_idle_ranges(spark):
    moved = [True] * 20 + [False] * 7 + [True] * 18
    df = spark.createDataFrame([(0, i, m) for i, m in enumerate(moved)], "episode_index long, frame_index long, moved boolean")
    got = windows.idle_free_ranges(df, F.col("moved")).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 10), (27, 35)]


def test_rename_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        transforms.rename(df, {"[ab]": "c"})
    assert transforms.rename(df, {"a": None, "(b)": r"\1/x"}).select("b.x").first()[0] == 2
    with pytest.raises(KeyError):
        transforms.repack(df, {"x": "a/b"})


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "episode_index long, frame_index long, raw_state int, progress double")
    assert labels.progress(empty).count() == 0
    assert labels.delta_statistics(empty.withColumn("delta", F.col("progress"))).first().asDict() == {"mean": 0.0, "std": 1e-6}
    assert quality.episode_count(empty, 1).count() == 1


def test_gestures():
    assert edges(0b00, 0b11) == [(0, True), (1, True)] and edges(0b11, 0b01) == [(1, False)]
    state, fired = (True, None), []
    for t, left, right in [(0, 1, 1), (0.5, 1, 1), (1.0, 1, 1), (2.5, 1, 1), (2.6, 0, 1), (2.7, 1, 1), (4.0, 1, 1), (4.1, 0, 0), (4.2, 1, 1), (5.2, 1, 1)]:
        state, fire = hold_step(state, t, bool(left), bool(right), 1.0)
        fired += [t] if fire else []
    assert fired == [1.0, 5.2]


def test_streams(spark, tmp_path):
    from framewright.streaming import freshness

    spark.createDataFrame([("a", 0.0, "x"), ("a", 0.05, "tick"), ("a", 0.5, "tick"), ("b", 1.0, "tick")], "session string, t double, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, t double, kind string").parquet(str(tmp_path / "in"))
    q = freshness.snapshots(stream, {"x": 0.1}).writeStream.format("memory").queryName("snaps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    end = time.time() + 60
    while time.time() < end and sum(p["numInputRows"] for p in q.recentProgress) < 4:
        time.sleep(0.2)
    time.sleep(1)
    q.stop()
    assert sorted((r.session, r.tick, r.verdict) for r in spark.table("snaps").collect()) == [("a", 0.05, "ok"), ("a", 0.5, "stale x"), ("b", 1.0, "missing x")]


def test_label_arrays_and_masks(spark):
    from pyspark.sql import functions as F

    from framewright.operators import records

    rows = [(1, [0, 1, 2]), (2, [0, 2, 1]), (3, [0, 7]), (4, [0, None]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "k int, x array<int>")
    got = dict(df.select("k", records.label_array_problem(F.col("x"), [-1, 0, 1, 2], 2)).collect())
    assert got == {1: None, 2: "misplaced", 3: "unknown", 4: "null", 5: "null", 6: None}
    assert spark.range(1).select(records.alternating_mask(0)).first()[0] == []


def test_nearest_against_brute_force(spark):
    import random

    from framewright.operators import records

    rng = random.Random(5)
    rows = [(e, i, float(t), float(i * 10 + e)) for e in range(4) for i, t in enumerate(sorted(rng.sample(range(60), 12)))]
    df = spark.createDataFrame(rows, "episode_index int, frame_index int, t double, s0 double")
    got = {(r[0], r[1]): r[2] for r in records.nearest(df, "t", "s0", 2.5, 3.0, "later").select("episode_index", "frame_index", "later").collect()}
    for e, i, t, _ in rows:
        near = [(abs(u - t - 2.5), u, v) for e2, _, u, v in rows if e2 == e and abs(u - t - 2.5) <= 3.0]
        assert got[e, i] == (min(near)[2] if near else None)
    assert records.nearest(df.limit(0), "t", "s0", 2.5, 3.0, "later").count() == 0
