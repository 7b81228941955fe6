"""Queries over whole datasets: totals, masks, schemas, catalogs, samplers, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions.vectors import doubles
from framewright.operators import datasets, joins, quality, windows
from framewright.plans.queries_sequence import shards
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, episodes, frames, table


@query(f"WITH {FRAMES}, s AS (SELECT episode_index AS shard, length, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS start, sum(length) OVER (ORDER BY episode_index)::BIGINT + CASE WHEN episode_index % 8 = 3 THEN 1 ELSE 0 END AS end_ FROM ep) SELECT shard, start, end_ FROM (SELECT *, coalesce(lag(end_) OVER (ORDER BY shard), 0) AS e FROM s) WHERE start <> e OR end_ <> start + length")
def w18_contiguity(spark, sf):
    lengths = shards(spark, sf).withColumn("length", F.col("end_") - F.col("start"))
    moved = lengths.withColumn("end_", F.col("end_") + F.when(F.col("shard") % 8 == 3, 1).otherwise(0))
    return quality.broken_ranges(moved, "shard", "start", "end_", "length").select("shard", "start", "end_")


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def j13_matching_files(spark, sf):
    files = table(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha"))
    manifest = files.where("p_partkey % 7 <> 0").withColumn("sha", F.when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.col("sha")))
    return datasets.matching_files(files, manifest, "p_partkey", ["sha"])


@query("SELECT event_id FROM events WHERE event_id % 13 = 2")
def j18_misaligned(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return datasets.misaligned(e.withColumn("user_id", F.col("user_id") + F.when(F.col("event_id") % 13 == 2, 1).otherwise(0)), e, "event_id", ["user_id"])


@query(f"WITH {FRAMES} SELECT episode_index, frame_index FROM f WHERE episode_index % 2 = 0 AND (frame_index < 5 OR frame_index BETWEEN 10 AND 19)")
def flt07_src16_keep_ranges(spark, sf):
    df = frames(spark, sf).select("episode_index", "frame_index")
    kept = df.where("frame_index = 0 AND episode_index % 2 = 0").select("episode_index", F.expr("array(array(0L, 5L), array(10L, 20L))").alias("ranges"))
    return datasets.keep_in_ranges(df, datasets.explode_ranges(kept, "ranges"))


@query(f"WITH {FRAMES} SELECT episode_index, length FROM ep ORDER BY episode_index")
def srt01_episode_order(spark, sf):
    return episodes(frames(spark, sf)).select("episode_index", "length").orderBy("episode_index")


@query("SELECT round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: pow(x - greatest(-1, least(1, 20 * x)), 2)))), 6) AS loss FROM embeddings")
def scl21_clipped_loss(spark, sf):
    e = table(spark, sf, "embeddings").select(doubles("embedding").alias("v"))
    return e.agg(F.round(F.avg(datasets.clipped_loss(F.col("v"), F.transform("v", lambda x: x * 20))), 6).alias("loss"))


@query("SELECT DISTINCT event_type, (SELECT x FROM (VALUES ('click'), ('error'), ('purchase'), ('scroll'), ('view')) v(x) ORDER BY levenshtein(substr(event_type, 2), x), x LIMIT 1) AS suggestion FROM events")
def str10_closest_name(spark, sf):
    kinds = table(spark, sf, "events").select("event_type").distinct()
    return kinds.select("event_type", datasets.closest_name(F.substring("event_type", 2, 100), ["click", "error", "purchase", "scroll", "view"]).alias("suggestion"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'top,wrist' ELSE 'top' END AS cameras FROM customer")
def map01_allowed_keys(spark, sf):
    cameras = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("wrist"), F.lit(1), F.lit("side"), F.lit(2), F.lit("top"), F.lit(3))).otherwise(F.create_map(F.lit("side"), F.lit(1), F.lit("top"), F.lit(2)))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(datasets.allowed_keys(cameras, ["top", "wrist"]), ",").alias("cameras"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '/mode' WHEN 'purchase' THEN '/save' END AS topic FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 5 <> 0")
def stm11_command_routing(spark, sf):
    topic = datasets.route(F.col("event_type"), {"click": "/mode", "purchase": "/save"}, F.col("event_id") % 5 != 0)
    return table(spark, sf, "events").select("event_id", topic.alias("topic")).where("topic IS NOT NULL")


@query(f"WITH {FRAMES} SELECT a.episode_index, a.frame_index, b.s0 AS status FROM f a ASOF JOIN (SELECT * FROM f WHERE task = 'purchase') b ON a.episode_index = b.episode_index AND a.t >= b.t WHERE a.task = 'click' AND a.t - b.t <= 86400")
def stm17_fresh_toggle(spark, sf):
    df = frames(spark, sf)
    status = df.where("task = 'purchase'").select("episode_index", "t", F.col("s0").alias("status"))
    acted = joins.as_of(df.where("task = 'click'").select("episode_index", "frame_index", "t"), status, ["episode_index"], "t", "status", 86400.0)
    return acted.where("status IS NOT NULL").select("episode_index", "frame_index", "status")


@query("WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position, count(*) OVER () AS n FROM events), a AS (SELECT event_id, position FROM p UNION ALL SELECT event_id, n + position FROM p WHERE n + position < (n + 6) // 7 * 7) SELECT event_id, position, position % 7 AS rank FROM a")
def smp06_distributed_share(spark, sf):
    return datasets.distributed_share(table(spark, sf, "events"), "event_id", 7)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def smp08_batches_and_back(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return datasets.from_batches(datasets.to_batches(rows, ["l_orderkey"], "l_linenumber"))


@query(f"WITH {FRAMES} SELECT * FROM (SELECT 'total_episodes' AS total, 20 AS declared, count(*) AS found FROM ep UNION ALL SELECT 'total_frames', 440, sum(length)::BIGINT FROM ep) WHERE declared <> found")
def dq03_dq04_totals(spark, sf):
    return datasets.total_differences(episodes(frames(spark, sf)), {"total_episodes": 20, "total_frames": 440})


@query(f"WITH {FRAMES} SELECT episode_index, frame_index FROM (SELECT *, lag(intervention) OVER (PARTITION BY episode_index ORDER BY frame_index) AS b FROM f) WHERE episode_index % 5 = 0 AND NOT intervention AND b")
def dq07_expert_mask(spark, sf):
    df = frames(spark, sf).select("episode_index", "frame_index", "intervention")
    segments = windows.runs(df, F.col("intervention")).withColumn("end_frame", F.col("end_frame") + F.when(F.col("episode_index") % 5 == 0, 1).otherwise(0))
    return datasets.mask_differences(df, segments.select("episode_index", "start_frame", "end_frame"), "intervention").select("episode_index", "frame_index")


@query("SELECT coalesce(a.k, b.k) AS k, declared, found FROM (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS declared FROM orders) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS found FROM lineitem GROUP BY 1) b ON a.k = b.k WHERE declared IS DISTINCT FROM found")
def dq17_row_counts(spark, sf):
    declared = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("n"))
    return datasets.count_differences(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), declared, "k", "n")


@query("SELECT * FROM (VALUES ('l_comment', 'string', NULL), ('l_quantity', NULL, 'double'), ('l_tax', 'float', 'double')) v(name, declared, found)")
def dq18_j20_schema(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_tax", "l_quantity")
    return datasets.schema_differences(rows, {"l_orderkey": "bigint", "l_tax": "float", "l_comment": "string"})


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 1)")
def dq21_references(spark, sf):
    known = table(spark, sf, "nation").where("n_nationkey % 4 <> 1")
    return quality.broken_links(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), known, F.col("c_nationkey"), "n_nationkey").select("c_custkey")


@query(f"WITH {FRAMES} SELECT max(episode_index) AS last, 0 AS current FROM ep HAVING max(episode_index) <> 0")
def dq25_last_shard(spark, sf):
    return datasets.not_last(shards(spark, sf), "shard", "start", 0)


@query(f"WITH {FRAMES} SELECT episode_index, arg_min(task, frame_index) AS task, count(*) AS n_frames FROM f GROUP BY episode_index")
def src19_replay_catalog(spark, sf):
    return datasets.replay_catalog(frames(spark, sf))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN user_id END AS x FROM events")
def src20_tracking_messages(spark, sf):
    value = F.concat(F.lit('{"x": '), F.col("user_id").cast("string"), F.lit("}"))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = F.when(F.col("event_id") % 3 == 2, "Other").otherwise("Tracking")
    message = F.concat(F.lit('{"functionName": "'), name, F.lit('", "value": '), F.when(F.col("event_id") % 2 == 0, value).otherwise(quoted), F.lit("}"))
    return table(spark, sf, "events").select("event_id", datasets.tracking_field(message, "Tracking", "x").cast("long").alias("x"))


@query(f"WITH {FRAMES}, k AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS new_episode, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS start FROM ep WHERE episode_index % 4 <> 1) SELECT new_episode, frame_index, start + frame_index AS index FROM f JOIN k USING (episode_index)")
def snk03_delete_episodes(spark, sf):
    df = frames(spark, sf).select("episode_index", "frame_index")
    eps = df.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return datasets.delete_episodes(df, eps, eps.where("episode_index % 4 = 1")).select("new_episode", "frame_index", "index")


@query("SELECT user_id, CASE WHEN bool_or(event_id % 97 = 0) THEN 'partial' ELSE 'ready' END AS kind FROM events GROUP BY user_id")
def snk09_label_documents(spark, sf):
    labelled = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 97 != 0, F.col("event_type")).alias("label"))
    return datasets.label_document_kind(labelled, "user_id", "label")


@query("SELECT event_id, event_id % 5 = 0 AS strict FROM events")
def jsn02_strict_json(spark, sf):
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, '{"a": 1, "b": {"a": 2}}').when(kind == 1, '{"a": 1, "a": 2}').when(kind == 2, '{"a": NaN}').when(kind == 3, '[{"b": {"c": 1, "c": 1}}]')
    return table(spark, sf, "events").select("event_id", datasets.is_strict_json(text).alias("strict"))
