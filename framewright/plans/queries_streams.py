"""Stored events as streams: replayed with a limited rate and a restart, logged as metrics, timed out, sampled at ticks. Each query runs its stream over all that is stored and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import sessions
from framewright.plans.registry import query
from framewright.plans.views import table
from framewright.sources import filesystem as fs
from framewright.sources import messages
from framewright.streaming import metrics, timers


def replayed(spark, sf, columns: list[str], label: str, put, stops: int = 0) -> str:
    """Run all events through a stream of five micro-batches or so, stopped after ``stops`` of them and started again; returns the folder."""
    root = fs.scratch(spark, label)
    messages.register(spark)
    total = messages.write_messages(table(spark, sf, "events").select(*columns), f"{root}/messages", "event_id", 4000)
    for last in (False, True) if stops else (True,):
        source = spark.readStream.format("stored_messages").option("path", f"{root}/messages").option("rate", max(1, total // 5)).option("checkpoint", f"{root}/checkpoint").load()
        q = source.writeStream.foreachBatch(lambda df, batch: put(df, batch, root)).option("checkpointLocation", f"{root}/checkpoint").start()
        try:
            if last:
                q.processAllAvailable()
            else:
                while q.isActive and len(q.recentProgress) < stops:
                    q.awaitTermination(0.1)
        finally:
            q.stop()
    return root


@query("SELECT event_id, event_id AS offset, event_type, value FROM events")
def src21_replayed_messages(spark, sf):
    """Stopped after two micro-batches and started again: each message once, in its place."""
    root = replayed(spark, sf, ["event_id", "event_type", "value"], "replayed", lambda df, batch, root: df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}"), stops=2)
    return spark.read.parquet(f"{root}/out").select("event_id", "offset", "event_type", "value")


@query("SELECT event_id AS step, value FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL")
def snk14_metric_log(spark, sf):
    """Every micro-batch is written twice; the second time changes nothing."""

    def put(df, batch, root):
        log = metrics.MetricLog(df.sparkSession, f"{root}/log")
        rows = df.where("event_id % 3 = 0 AND value IS NOT NULL").select(F.col("event_id").alias("step"), F.create_map(F.lit("value"), "value").alias("metrics"))
        if log.write(rows, batch) == log.write(rows, batch):
            raise AssertionError(f"batch {batch} was logged twice or not at all")

    root = replayed(spark, sf, ["event_id", "value"], "metrics", put)
    return metrics.MetricLog(spark, f"{root}/log").read().select("step", F.col("metrics")["value"].alias("value"))


@query("SELECT DISTINCT user_id, t + 20000.0 AS t FROM (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_type, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) WHERE event_type <> 'error' AND (nx IS NULL OR nx - t > 20000.0)")
def stm10_input_timeouts(spark, sf):
    known = F.when(F.col("event_type") != "error", True)
    samples = table(spark, sf, "events").select("user_id", (F.expr("unix_micros(CAST(ts AS TIMESTAMP))") / 1e6).alias("t"), known.alias("left"), known.alias("right"))
    return sessions.input_timeouts(samples, "user_id", 20_000.0)


@query("""WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value FROM events), s AS (SELECT user_id, min(ms) AS a, max(ms) AS z FROM m GROUP BY user_id),
k AS (SELECT user_id, a + unnest(range((z - a) // 3600000 + 1)) * 3600000 AS tick FROM s), l AS (SELECT user_id, ms, max_by(value, (value, 1)) AS value FROM m GROUP BY user_id, ms)
SELECT session, tick, value FROM (SELECT k.user_id::VARCHAR AS session, tick, l.ms, value FROM k ASOF JOIN l ON k.user_id = l.user_id AND k.tick >= l.ms) WHERE tick - ms <= 1800000""")
def stm03_streamed_ticks(spark, sf):
    """Every user's hours, sampled by timers of a stream over its events; the watermark comes from a row far on."""
    root = fs.scratch(spark, "ticks")
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("ms"), "value")
    # of samples at one time the largest value comes last, as in the stream's order
    spans = events.groupBy("session").agg(F.min("ms").alias("a"), F.max("ms").alias("z"))
    none = F.lit(None).cast("double")
    marks = spans.select("session", F.col("a").alias("ms"), F.lit("start").alias("kind"), none.alias("value")).unionByName(spans.select("session", F.col("z").alias("ms"), F.lit("end").alias("kind"), none.alias("value")))
    rows = marks.unionByName(events.select("session", "ms", F.lit("sample").alias("kind"), "value"))
    ahead = rows.agg(F.max("ms")).first()[0]
    rows.write.parquet(f"{root}/in/part=0")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    timers.state_store(spark)
    try:
        source = spark.readStream.schema("session string, ms long, kind string, value double, part int").parquet(f"{root}/in")
        ticks = timers.tick_samples(source.withColumn("ts", F.timestamp_millis("ms")), 3_600_000, 1_800_000, "1 hour")
        q = ticks.writeStream.option("checkpointLocation", f"{root}/checkpoint").format("parquet").option("path", f"{root}/out").outputMode("append").start()
        q.processAllAvailable()
        for i in (1, 2):  # one moves the watermark past all, the next one lets timers see it
            spark.createDataFrame([("clock", (ahead or 0) + i * 86_400_000, "sample", None)], "session string, ms long, kind string, value double").write.parquet(f"{root}/in/part={i}")
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("session string, tick long, value double").parquet(f"{root}/out")
