"""Stored messages, streamed with a limited rate and restarted, and the metric log behind a stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from framewright.sources import filesystem as fs
from framewright.sources import messages as M
from framewright.streaming import metrics


@pytest.fixture
def stored(spark, tmp_path):
    M.register(spark)
    path = str(tmp_path / "messages")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    assert M.write_messages(events.where("event_id < 700"), path, "event_id", 130) == 700
    return path


def stream(spark, path, tmp_path, rate):
    return spark.readStream.format("stored_messages").option("path", path).option("rate", rate).option("checkpoint", str(tmp_path / "checkpoint")).load()


def test_as_a_table(spark, stored):
    df = spark.read.format("stored_messages").option("path", stored).load()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 700").orderBy("event_id").collect()
    rows = df.orderBy("offset").collect()
    assert [(r.offset, r.event_id, r.event_type, r.value) for r in rows] == [(i, e.event_id, e.event_type, e.value) for i, e in enumerate(events)]
    assert [r.offset for r in df.where("offset >= 120 AND offset < 140").orderBy("offset").collect()] == list(range(120, 140)) and df.where("offset >= 5000").count() == 0
    assert [(s.start, s.end) for s in M.slices(stored, 100, 300, 90)] == [(100, 130), (130, 220), (220, 260), (260, 300)]
    assert [b.num_rows for s in M.slices(stored, 100, 300, 90) for b in M.read_slice(s)] == [30, 90, 40, 40]
    with pytest.raises(Exception, match="no messages"):
        spark.read.format("stored_messages").option("path", stored + "-none").load()


@pytest.mark.parametrize("lost", [False, True])
def test_each_message_once_over_restarts(spark, stored, tmp_path, lost):
    """Stopped in the middle, or lost between writing a batch and logging it as done; more messages come meanwhile."""
    log = metrics.MetricLog(spark, str(tmp_path / "log"))
    seen = []

    def put(df, batch):
        log.write(df.select(F.col("offset").alias("step"), F.create_map(F.lit("value"), F.col("value")).alias("metrics")).where("step % 50 = 0"), batch)
        df.select("offset").write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}"))
        seen.append((batch, df.count()))
        if lost and len(seen) == 3:
            raise RuntimeError("lost")

    def run(until=None):
        q = stream(spark, stored, tmp_path, 90).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            if until is None:
                q.processAllAvailable()
            while until and len(seen) < until and q.isActive:
                q.awaitTermination(0.2)
        except Exception as reason:
            assert lost and "lost" in str(reason)
        q.stop()

    run(3)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    assert M.write_messages(events.where("event_id >= 700"), stored, "event_id", 130) == 1000
    run()
    offsets = [r.offset for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(offsets) == list(range(1000)) and max(n for _, n in seen) <= 90
    assert sorted(r.step for r in log.read().collect()) == list(range(0, 1000, 50))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def batch(spark, *rows):
    return spark.createDataFrame(rows, "step long, metrics map<string,double>")


def test_a_metric_log(spark, tmp_path):
    log = metrics.MetricLog(spark, str(tmp_path / "log"), "critic_step")
    assert log.last_step() is None and log.read().collect() == []
    assert log.write(batch(spark, (3, {"loss": 0.5, "a\"b": -1e-7}), (1, {"loss": 2.0})), 0)
    assert log.last_step() == 3
    assert not log.write(batch(spark, (9, {"loss": 9.0})), 0)  # replayed, whatever it holds
    for wrong in ([(3, {"x": 1.0})], [(2, {})], [(5, {"x": math.nan})], [(5, {"x": math.inf})], [(5, {"": 1.0})], [(5, {"critic_step": 1.0})], [(5, {}), (5, {})], [(None, {})], [(5, None)], [(5, {"x": None})]):
        with pytest.raises(metrics.MetricError):
            log.write(batch(spark, *wrong), 1)
    assert log.write(batch(spark), 1) and log.last_step() == 3 and log.write(batch(spark, (4, {})), 2)
    with pytest.raises(metrics.MetricError):
        log.write(batch(spark, (8, {})), 1 - 2)
    assert sorted((r.step, tuple(sorted(r.metrics.items()))) for r in log.read().collect()) == [(1, (("loss", 2.0),)), (3, (('a"b', -1e-7), ("loss", 0.5))), (4, ())]
    first = next(n for n in fs.children(spark, f"{log.root}/lines") if n.startswith("000000000000"))
    lines = [json.loads(x) for x in fs.read_text(spark, f"{log.root}/lines/{first}").splitlines()]
    assert lines == [{"critic_step": 1, "loss": 2.0}, {"a\"b": -1e-7, "critic_step": 3, "loss": 0.5}] and list(lines[1]) == sorted(lines[1])


def test_a_killed_batch_leaves_no_trace_for_readers(spark, tmp_path, monkeypatch):
    log = metrics.MetricLog(spark, str(tmp_path / "log"))
    log.write(batch(spark, (1, {"x": 1.0})), 0)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(fs, "put_if_absent", killed)
        with pytest.raises(KeyboardInterrupt):
            log.write(batch(spark, (2, {"x": 2.0})), 1)
    assert [r.step for r in log.read().collect()] == [1] and log.last_step() == 1
    assert log.write(batch(spark, (2, {"x": 2.5})), 1) and sorted(r.step for r in log.read().collect()) == [1, 2]
