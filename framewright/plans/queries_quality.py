"""Constraint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import labels, quality, statistics
from framewright.plans.queries_aggregate import DIMS, PROGRESS
from framewright.plans.queries_sequence import STARTS, shards
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, episodes, frames, state, table


@query(f"WITH {FRAMES} SELECT count(*) AS n, count(DISTINCT episode_index) AS n_distinct, min(episode_index) AS low, max(episode_index) AS high FROM ep HAVING NOT (count(*) = 20 AND count(DISTINCT episode_index) = 20 AND min(episode_index) = 0 AND max(episode_index) = 19)")
def dq01_episode_count(spark, sf):
    return quality.episode_count(episodes(frames(spark, sf)), 20)


@query(f"WITH {FRAMES}, s AS (SELECT episode_index, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT + CASE WHEN episode_index % 10 = 7 THEN 1 ELSE 0 END AS start, sum(length) OVER (ORDER BY episode_index)::BIGINT AS end_ FROM ep), q AS (SELECT *, coalesce(lag(end_) OVER (ORDER BY episode_index), 0) AS expected FROM s) SELECT episode_index AS shard, start, end_, expected FROM q WHERE start <> expected")
def dq02_dq13_contiguous_ranges(spark, sf):
    moved = shards(spark, sf).withColumn("start", F.col("start") + F.when(F.col("shard") % 10 == 7, 1).otherwise(0))
    return quality.broken_ranges(moved, "shard", "start", "end_")


@query(f"WITH {FRAMES}, l AS (SELECT episode_index, frame_index, CASE WHEN frame_index % 13 = 5 THEN NULL WHEN frame_index % 17 = 3 THEN 2 ELSE raw_state END AS label, max(frame_index) OVER (PARTITION BY episode_index) AS last_ FROM f) SELECT episode_index, frame_index, label FROM l WHERE label IS NULL OR (label = 2 AND frame_index <> last_)")
def dq05_bad_labels(spark, sf):
    n = F.col("frame_index")
    label = F.when(n % 13 == 5, F.lit(None).cast("int")).when(n % 17 == 3, 2).otherwise(F.col("raw_state"))
    return quality.bad_labels(frames(spark, sf).select("episode_index", "frame_index", label.alias("label")), "label", [-1, 0, 1, 2], 2)


@query(f"WITH {FRAMES}, k AS (SELECT episode_index, frame_index + CASE WHEN frame_index > 40 THEN 1 ELSE 0 END AS frame_index FROM f) SELECT episode_index, frame_index, expected FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS expected FROM k) WHERE frame_index <> expected")
def dq08_dq19_broken_indices(spark, sf):
    gap = frames(spark, sf).select("episode_index", (F.col("frame_index") + F.when(F.col("frame_index") > 40, 1).otherwise(0)).alias("frame_index"))
    return quality.broken_indices(gap)


@query("SELECT vec_id FROM embeddings WHERE vec_id % 9 = 0")
def dq09_bad_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("v"))
    return quality.bad_vectors(e, "v", 64).select("vec_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'extra' WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE 'differs' END AS reason FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 5 = 0 AND o_orderkey % 6 <> 0 OR o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 6 <> 0")
def dq10_dq20_manifest(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    changed = o.where("o_orderkey % 6 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1.0).otherwise(0.0))
    return quality.manifest_differences(o.where("o_orderkey % 5 <> 0"), changed, "o_orderkey", ["o_totalprice"])


@query(f"WITH {FRAMES}, {STARTS} SELECT ts.episode_index, start_frame FROM ts WHERE start_frame <> length - 20 AND NOT EXISTS (SELECT 1 FROM f WHERE f.episode_index = ts.episode_index AND f.frame_index = start_frame + 20 AND f.frame_index % 2 = 0)")
def dq11_broken_next(spark, sf):
    df = frames(spark, sf)
    key = F.when(~F.col("terminal"), F.struct("episode_index", F.col("next_frame").alias("frame_index")))
    targets = df.where("frame_index % 2 = 0").select(F.struct("episode_index", "frame_index").alias("at"))
    return quality.broken_links(labels.transition_starts(episodes(df)), targets, key, "at").select("episode_index", "start_frame")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq12_duplicate_keys(spark, sf):
    return quality.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {FRAMES}, {DIMS} SELECT dim FROM d GROUP BY dim HAVING stddev_pop(x) < 0 OR quantile_cont(x, 0.99) < quantile_cont(x, 0.01)")
def dq14_norm_stats(spark, sf):
    return quality.bad_norm_stats(statistics.feature_statistics(state(frames(spark, sf)), "state")).select("dim")


@query(f"WITH {FRAMES}, {PROGRESS} SELECT episode_index, frame_index FROM p WHERE progress > 0.9")
def dq15_progress_range(spark, sf):
    return quality.out_of_range(labels.progress(frames(spark, sf)), "progress", 0.0, 0.9).select("episode_index", "frame_index")
