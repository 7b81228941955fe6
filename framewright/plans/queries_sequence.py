"""Windows, runs, progress, weights, transitions, joins of frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import joins, labels, windows
from framewright.plans.queries_aggregate import ISLANDS, PROGRESS, SCORE, WEIGHTS, weights
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, episodes, frames, state, table

NUMBERED = "n AS (SELECT episode_index, length, row_number() OVER (ORDER BY episode_index) - 1 AS new_episode, sum(length) OVER (ORDER BY episode_index) - length AS off FROM ep WHERE length >= 60)"


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events")
def w01_renumber_frames(spark, sf):
    return windows.renumber_frames(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "frame_index")


@query(f"WITH {FRAMES}, {NUMBERED} SELECT f.episode_index, new_episode, frame_index, (off + frame_index)::BIGINT AS index FROM f JOIN n USING (episode_index)")
def w02_dense_renumber(spark, sf):
    df = frames(spark, sf)
    return windows.renumber_episodes(df.select("episode_index", "frame_index"), episodes(df).where("length >= 60")).select("episode_index", "new_episode", "frame_index", "index")


@query(f"WITH {FRAMES} SELECT a.episode_index, a.frame_index, list(b.s0 ORDER BY k) AS ahead FROM f a, range(0, 4) r(k), f b, ep WHERE ep.episode_index = a.episode_index AND b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + k, ep.length - 1) GROUP BY ALL", vectors=("ahead",))
def w03_forward_window(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", windows.forward_window("s0", 4).alias("ahead"))


@query(f"WITH {FRAMES} SELECT a.episode_index, a.frame_index, list(b.s0 ORDER BY k DESC) AS history FROM f a, range(0, 4) r(k), f b WHERE b.episode_index = a.episode_index AND b.frame_index = greatest(a.frame_index - 2 * k, 0) GROUP BY ALL", vectors=("history",))
def w04_backward_window(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", windows.backward_window("s0", 3, 2).alias("history"))


@query(f"WITH {FRAMES} SELECT a.episode_index, a.frame_index, b.s0 AS future FROM f a, f b, ep WHERE ep.episode_index = a.episode_index AND b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + 5, ep.length - 1)")
def w05_future_value(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", windows.future_value("s0", 5).alias("future"))


@query(f"WITH {FRAMES}, {SCORE} SELECT episode_index, frame_index, score::DOUBLE AS score FROM s")
def w06_cumulative_score(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", labels.cumulative_score("raw_state").alias("score"))


@query(f"WITH {FRAMES}, {PROGRESS} SELECT episode_index, frame_index, round(progress, 9) AS progress FROM p")
def w07_progress(spark, sf):
    return labels.progress(frames(spark, sf)).select("episode_index", "frame_index", F.round("progress", 9).alias("progress"))


@query(f"WITH {FRAMES} SELECT episode_index, frame_index, round(s0 - lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index), 6) AS diff FROM f")
def w08_first_difference(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", F.round(windows.first_difference("s0"), 6).alias("diff"))


@query(f"WITH {FRAMES}, {ISLANDS.format('s0 > 50')} SELECT episode_index, start_frame, end_frame, n_frames FROM r")
def w09_runs(spark, sf):
    return windows.runs(frames(spark, sf), F.col("s0") > 50)


@query(f"""WITH {FRAMES}, v AS (SELECT episode_index, frame_index, nullif(raw_state, 2) AS v FROM f),
c AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS nw FROM v WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY episode_index ORDER BY frame_index) AS run FROM c)
SELECT episode_index, min(frame_index) AS start_frame, max(frame_index) + 1 AS end_frame, v FROM g WHERE v IS NOT NULL GROUP BY episode_index, run, v""")
def w10_value_runs(spark, sf):
    return windows.value_runs(frames(spark, sf).withColumn("v", F.when(F.col("raw_state") != 2, F.col("raw_state"))), "v")


@query(f"WITH {FRAMES}, {ISLANDS.format('intervention')} SELECT episode_index, start_frame, end_frame - 1 AS end_frame_index FROM r")
def w11_expert_segments(spark, sf):
    return windows.runs(frames(spark, sf), F.col("intervention")).select("episode_index", "start_frame", (F.col("end_frame") - 1).alias("end_frame_index"))


@query(f"WITH {FRAMES}, {PROGRESS}, x AS (SELECT episode_index, frame_index, progress - lag(progress) OVER (PARTITION BY episode_index ORDER BY frame_index) AS d FROM p) SELECT episode_index, frame_index, CASE WHEN d > 0.001 THEN 1 WHEN d < -0.001 THEN -1 ELSE 0 END AS target FROM x")
def w12_interval_targets(spark, sf):
    return labels.progress(frames(spark, sf)).select("episode_index", "frame_index", labels.interval_targets(windows.first_difference("progress"), 0.001).alias("target"))


STARTS = "ts AS (SELECT episode_index, length, unnest(list_distinct(list_append(range(0, length - 19, 2), length - 20))) AS start_frame FROM ep WHERE length >= 20)"


@query(f"WITH {FRAMES}, {STARTS} SELECT episode_index, start_frame, CASE WHEN start_frame = length - 20 THEN -1 ELSE start_frame + 20 END AS next_frame, start_frame = length - 20 AS terminal FROM ts")
def w13_w15_transition_starts(spark, sf):
    return labels.transition_starts(episodes(frames(spark, sf)))


@query(f"WITH {FRAMES}, {STARTS} SELECT ts.episode_index, start_frame, sum(raw_state)::BIGINT AS reward FROM ts JOIN f ON f.episode_index = ts.episode_index AND f.frame_index >= start_frame AND f.frame_index < start_frame + 20 GROUP BY ALL")
def w14_chunk_reward(spark, sf):
    df = frames(spark, sf)
    return labels.transitions(df, episodes(df)).select("episode_index", "start_frame", "reward")


@query(f"WITH {FRAMES} SELECT episode_index, frame_index, CASE WHEN count(s0) OVER w = 30 THEN round(avg(s0) OVER w, 6) END AS age FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS 29 PRECEDING)")
def w16_moving_average(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", F.round(windows.full_average("s0", 30), 6).alias("age"))


@query(f"WITH {FRAMES} SELECT episode_index, frame_index, sum(CASE WHEN s0 > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_index ORDER BY frame_index)::BIGINT AS stale FROM f")
def w17_stale_counter(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", windows.running_count(F.col("s0") > 100).alias("stale"))


@query(f"WITH {FRAMES} SELECT episode_index, frame_index // 8 AS chunk, frame_index % 8 AS element, s0 FROM f")
def w20_chunk_cursor(spark, sf):
    return frames(spark, sf).select("episode_index", F.floor(F.col("frame_index") / 8).alias("chunk"), (F.col("frame_index") % 8).alias("element"), "s0")


@query(f"WITH {FRAMES} SELECT episode_index, frame_index // 8 AS chunk, frame_index % 8 AS element, s0 FROM f WHERE frame_index % 8 < 5")
def w21_replan(spark, sf):
    return w20_chunk_cursor(spark, sf).where("element < 5")


@query(f"WITH {FRAMES}, {PROGRESS}, {WEIGHTS} SELECT episode_index, frame_index, round(weight, 5) AS weight FROM wt")
def scl08_sample_weights(spark, sf):
    return weights(spark, sf).select("episode_index", "frame_index", F.round("weight", 5).alias("weight"))


# ---- joins


@query(f"WITH {FRAMES}, {PROGRESS}, {WEIGHTS} SELECT f.episode_index, f.frame_index, coalesce(round(weight, 5), -1) AS weight FROM f LEFT JOIN wt ON wt.episode_index = f.episode_index AND wt.frame_index = f.frame_index AND f.episode_index % 5 <> 0")
def j01_frames_weights(spark, sf):
    known = weights(spark, sf).where("episode_index % 5 <> 0").select("episode_index", "frame_index", "weight")
    return frames(spark, sf).select("episode_index", "frame_index").join(known, ["episode_index", "frame_index"], "left").withColumn("weight", F.coalesce(F.round("weight", 5), F.lit(-1.0)))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 7 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def j02_unmatched_labels(spark, sf):
    return joins.unmatched(table(spark, sf, "documents").where("doc_id % 7 <> 0"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j03_task_lookup(spark, sf):
    tasks = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(tasks, "c_nationkey").select("c_custkey", "n_name")


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def j04_annotations_tasks(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return orders.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "o_orderdate")


@query(f"WITH {FRAMES}, {STARTS} SELECT ts.episode_index, start_frame, a.s0 AS current_feature, b.s0 AS next_feature FROM ts JOIN f a ON a.episode_index = ts.episode_index AND a.frame_index = start_frame LEFT JOIN f b ON b.episode_index = ts.episode_index AND b.frame_index = start_frame + 20 AND start_frame <> length - 20")
def j06_transition_features(spark, sf):
    df = frames(spark, sf)
    rows = labels.with_features(labels.transitions(df, episodes(df)), df.select("episode_index", "frame_index", "s0"), "s0")
    return rows.select("episode_index", "start_frame", "current_feature", "next_feature")


SHARDS = "sh AS (SELECT episode_index AS shard, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS start, (sum(length) OVER (ORDER BY episode_index))::BIGINT AS end_ FROM ep)"


def shards(spark, sf):
    eps = windows.running_offset(episodes(frames(spark, sf)).select("episode_index", "length"), "episode_index", "length", "start")
    return eps.select(F.col("episode_index").alias("shard"), "start", (F.col("start") + F.col("length")).alias("end_"))


@query(f"WITH {FRAMES}, {SHARDS} SELECT event_id, shard, event_id - start AS local_index FROM events JOIN sh ON event_id >= start AND event_id < end_")
def j07_index_to_shard(spark, sf):
    found = joins.range_join(table(spark, sf, "events").select("event_id"), shards(spark, sf), "event_id", "start", "end_", [], 64)
    return found.select("event_id", "shard", (F.col("event_id") - F.col("start")).alias("local_index"))


@query(f"WITH {FRAMES}, {ISLANDS.format('raw_state = 0')} SELECT f.episode_index, f.frame_index FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.episode_index = f.episode_index AND f.frame_index >= r.start_frame AND f.frame_index < r.end_frame AND n_frames >= 3)")
def j08_range_semi_join(spark, sf):
    df = frames(spark, sf)
    ranges = windows.runs(df, F.col("raw_state") == 0).where("n_frames >= 3")
    return joins.range_join(df.select("episode_index", "frame_index"), ranges, "frame_index", "start_frame", "end_frame", ["episode_index"], 16, "left_semi").select("episode_index", "frame_index")


@query(f"WITH {FRAMES}, {ISLANDS.format('raw_state = 0')} SELECT episode_index, greatest(start_frame, 10) AS start_frame, least(end_frame, 30) AS end_frame FROM r WHERE greatest(start_frame, 10) < least(end_frame, 30)")
def j09_interval_overlap(spark, sf):
    found = windows.runs(frames(spark, sf), F.col("raw_state") == 0)
    return joins.clip_intervals(found, F.lit(10).cast("long"), F.lit(30).cast("long")).select("episode_index", "start_frame", "end_frame")


@query(f"WITH {FRAMES}, {ISLANDS.format('intervention')} SELECT count(*) AS differing FROM f WHERE intervention <> EXISTS (SELECT 1 FROM r WHERE r.episode_index = f.episode_index AND f.frame_index >= r.start_frame AND f.frame_index < r.end_frame)")
def j10_mask_equals_segments(spark, sf):
    df = frames(spark, sf).select("episode_index", "frame_index", "intervention")
    marked = windows.runs(df, F.col("intervention")).select("episode_index", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame_index"), F.lit(True).alias("in_segment"))
    both = df.join(marked, ["episode_index", "frame_index"], "full_outer")
    return both.agg(F.count_if(F.coalesce("intervention", F.lit(False)) != F.coalesce("in_segment", F.lit(False))).alias("differing"))


@query("""WITH a AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), b AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value FROM events WHERE event_type = 'view')
SELECT a.user_id, a.event_id, CASE WHEN a.t - b.t <= 86400 THEN b.value END AS value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t""")
def j11_as_of_join(spark, sf):
    events = table(spark, sf, "events").withColumn("t", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) / 1e6"))
    left = events.where("event_type = 'click'").select("user_id", "event_id", "t")
    right = events.where("event_type = 'view'").select("user_id", "t", "value")
    return joins.as_of(left, right, ["user_id"], "t", "value", 86_400).select("user_id", "event_id", "value")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j12_not_migrated(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0) SELECT k, CASE WHEN a.s IS NULL THEN 'new' WHEN b.s IS NULL THEN 'gone' WHEN a.s = b.s THEN 'stable' ELSE 'busy' END AS verdict FROM a FULL JOIN b USING (k)")
def j15_compare_scans(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    second = o.where("k % 7 <> 0").withColumn("s", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("s")))
    return joins.compare_scans(o.where("k % 5 <> 0"), second, "k", "s")


@query(f"WITH {FRAMES} SELECT episode_index, v AS video_key FROM ep, (VALUES ('front'), ('left'), ('right')) x(v)")
def j17_episodes_by_video(spark, sf):
    keys = F.array(F.lit("front"), F.lit("left"), F.lit("right"))
    return episodes(frames(spark, sf)).select("episode_index", F.explode(keys).alias("video_key"))


@query(f"WITH {FRAMES}, {ISLANDS.format('raw_state = 0')}, q AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY start_frame) AS o FROM r) SELECT episode_index, frame_index, max(o) AS label FROM (SELECT episode_index, o, unnest(range(start_frame, end_frame + 2)) AS frame_index FROM q) GROUP BY ALL")
def j19_segments_to_labels(spark, sf):
    found = windows.runs(frames(spark, sf), F.col("raw_state") == 0).withColumn("o", F.row_number().over(Window.partitionBy("episode_index").orderBy("start_frame")))
    marked = found.select("episode_index", "o", F.explode(F.sequence("start_frame", F.col("end_frame") + 1)).alias("frame_index"))
    return marked.groupBy("episode_index", "frame_index").agg(F.max_by("o", "o").cast("long").alias("label"))
