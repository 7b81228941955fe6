"""Ticks and time-outs in streams with silent stretches: the batch twins' rows, whatever the micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import sessions
from framewright.streaming import timers


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, batches, schema, name, query):
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-in/part={i:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in/part=*"))
    source = source.withColumn("ts", F.timestamp_millis("ms"))
    q = query(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.table(name).collect())


def dealt(rng, rows, n):
    """In n micro-batches, later rows later, with those within 300 ms of each other in any order; at last one row far on, so that the watermark passes all."""
    rows = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 300))
    cuts = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[s:e] for s, e in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.mark.parametrize("n, seed", [(1, 1), (6, 2), (12, 3)])
def test_ticks_without_rows(spark, tmp_path, n, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(4):
        start = 1000 + 137 * s
        rows += [(f"s{s}", start, "start", None), (f"s{s}", start + rng.choice([2000, 2030, 2500]), "end", None)]
        t = start - 100
        for _ in range(30):
            t += rng.choice([10, 33, 50, 400])  # silent stretches
            rows.append((f"s{s}", t, "sample", float(t)))
    rows.append(("clock", 1000, "sample", 0.0))
    last = [("clock", 1_000_000, "sample", 0.0)]
    schema = "session string, ms long, kind string, value double"
    # the first row fixes no watermark yet, so nothing is late
    got = streamed(spark, tmp_path, [*dealt(rng, rows, n), last, [("clock", 1_000_001, "sample", 0.0)]], schema, f"ticks{n}", lambda s: timers.tick_samples(s, 33, 100, "1 second"))
    df = spark.createDataFrame(rows, schema)
    spans = df.where("session <> 'clock'").groupBy("session").agg(F.min(F.when(F.col("kind") == "start", F.col("ms"))).alias("start_t"), F.max(F.when(F.col("kind") == "end", F.col("ms"))).alias("end_t"))
    stored = sessions.tick_samples(df.where("kind = 'sample'").select("session", F.col("ms").alias("t"), "value"), spans, ["session"], 33, "value", 100)
    assert got == sorted((r.session, int(r.t), r.value) for r in stored.collect()) and len(got) > 60


@pytest.mark.parametrize("n, seed", [(1, 4), (9, 5)])
def test_time_outs_without_rows(spark, tmp_path, n, seed):
    rng = random.Random(seed)
    rows, schema = [], "session string, ms long, source string, left boolean, right boolean"
    for s in "ab":
        t = 5000
        for _ in range(60):
            t += rng.choice([50, 100, 250, 251, 900])
            rows.append((s, t, rng.choice("xxxxxy"), rng.choice([True] * 9 + [False, None]), rng.choice([True] * 9 + [False])))
    got = streamed(spark, tmp_path, [*dealt(rng, rows, n), [("z", 1_000_000, "x", None, None)], [("z", 1_000_001, "x", None, None)]], schema, f"holds{n}", lambda s: timers.dual_holds(s, 100, 250, "1 second"))
    df = spark.createDataFrame(rows, schema).withColumnRenamed("ms", "t").withColumn("id", F.col("t"))
    fired = [(r.session, int(r.t), "fired") for r in sessions.dual_holds(df.withColumn("t", F.col("t").cast("double")), "session", 100, 250).collect()]
    cleared = [(r.session, int(r.t), "cleared") for r in sessions.input_timeouts(df, "session", 250).collect()]
    assert got == sorted(fired + cleared) and len(fired) > 5 and len(cleared) > 10


def test_a_key_is_woken_by_its_timer_alone(spark, tmp_path):
    """Session a gets one sample and nothing more; another key's rows move the watermark on, and a's ticks come at their times and then stop."""
    schema = "session string, ms long, kind string, value double"
    batches = [[("a", 1000, "start", None), ("a", 1000, "sample", 7.0)], [("b", 2500, "sample", 0.0)], [("b", 9000, "sample", 0.0)], [("b", 9001, "sample", 0.0)]]
    got = streamed(spark, tmp_path, batches, schema, "alone", lambda s: timers.tick_samples(s, 500, 1200, "1 second"))
    assert got == [("a", 1000, 7.0), ("a", 1500, 7.0), ("a", 2000, 7.0)]
