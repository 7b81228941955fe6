"""Queries over bookkeeping records, ordered keys and small scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import joins, quality, records
from framewright.plans.queries_sequence import shards
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, episodes, frames, table


@query(f"WITH {FRAMES} SELECT episode_index, length - 5 AS start_frame, length - 5 + episode_index % 7 AS end_frame, length FROM ep WHERE NOT (length - 5 >= 0 AND length - 5 + episode_index % 7 < length)")
def dq06_bad_segments(spark, sf):
    eps = episodes(frames(spark, sf)).select("episode_index", "length")
    start = F.col("length") - 5
    segments = eps.select("episode_index", start.alias("start_frame"), (start + F.col("episode_index") % 7).alias("end_frame"))
    return records.bad_segments(segments, eps)


@query("SELECT * FROM (SELECT 'gaps in target' AS reason, count(*) AS n FROM orders HAVING min(o_orderkey) <> 0 OR max(o_orderkey) <> count(*) - 1 UNION ALL SELECT 'repeated source', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'repeated target', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) WHERE n > 0")
def dq24_manifest_targets(spark, sf):
    manifest = table(spark, sf, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("source"))
    return records.bad_targets(manifest, "target", ["source", "target"])


@query("SELECT 'differs' AS reason, event_id FROM events WHERE event_id % 11 = 4")
def dq26_frame_identity(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    read = e.withColumn("user_id", F.col("user_id") + F.when(F.col("event_id") % 11 == 4, 1).otherwise(0))
    return quality.manifest_differences(read, e, "event_id", ["user_id"])


@query(f"WITH {FRAMES} SELECT f.episode_index, f.frame_index, g.s0 AS later FROM f JOIN ep USING (episode_index) JOIN f g ON g.episode_index = f.episode_index AND g.frame_index = least(f.frame_index + 50, ep.length - 1)")
def j05_clamped_gather(spark, sf):
    return records.clamped_ahead(frames(spark, sf).select("episode_index", "frame_index", "s0"), "s0", 50, "later").select("episode_index", "frame_index", "later")


@query("SELECT o_orderkey, shard FROM orders, LATERAL (SELECT max(start) AS start FROM sh WHERE start <= o_orderkey) m JOIN sh ON sh.start = m.start WHERE o_orderkey < sh.end_".replace("SELECT o_orderkey, shard", f"WITH {FRAMES}, sh AS (SELECT episode_index AS shard, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS start, sum(length) OVER (ORDER BY episode_index)::BIGINT AS end_ FROM ep) SELECT o_orderkey, shard", 1))
def j14_index_to_episode(spark, sf):
    return joins.range_join(table(spark, sf, "orders").select("o_orderkey"), shards(spark, sf), "o_orderkey", "start", "end_", [], 64).select("o_orderkey", "shard")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, event_id * 7 % 13 AS k, lag(event_id * 7 % 13) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) WHERE k <= b")
def srt05_unsorted_keys(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 13).alias("k"))
    return records.unsorted_keys(e, "event_type", "k").select("event_type", "event_id")


@query("SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey ORDER BY l_suppkey")
def srt07_sorted_set(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 49").select("l_suppkey").distinct().orderBy("l_suppkey")


@query("SELECT o_orderdate, o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY ALL")
def srt02_composite_order(spark, sf):
    return table(spark, sf, "orders").select("o_orderdate", "o_custkey", "o_orderkey", "o_totalprice").orderBy("o_orderdate", "o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY quality NULLS LAST, doc_id")
def srt06_nulls_last(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return labelled.orderBy(F.col("quality").asc_nulls_last(), "doc_id")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def set05_symmetric_difference(spark, sf):
    wanted = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    return joins.unmatched(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), wanted, ["k"])


@query("SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.p_brand AS first, b.p_brand AS second FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) b USING (p_partkey)")
def set07_states_of_two_scans(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return records.union_of_states(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 4 <> 0"), "p_partkey", "p_brand")


@query("SELECT vec_id, [true, true, false, false, true] AS mask FROM embeddings", vectors=("mask",))
def scl07_mask(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", records.alternating_mask(2, 0, -2, 1).alias("mask"))


@query(f"WITH {FRAMES} SELECT episode_index, frame_index, frame_index / 30.0 AS seconds FROM f")
def dat03_frame_seconds(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", (F.col("frame_index") / F.lit(30.0)).alias("seconds"))


@query("SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def dat05_zoned_iso(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(day, F.lit("+02:00"))).when(F.col("event_id") % 4 == 1, day).when(F.col("event_id") % 4 == 2, F.lit("2024-13-40T00:00:00Z"))
    return table(spark, sf, "events").select("event_id", records.is_zoned_iso(text).alias("valid"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'none') AS task FROM customer")
def str09_alternate_names(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.lit("none")).alias("task"))


@query(f"WITH {FRAMES} SELECT episode_index, CASE WHEN bool_or(raw_state = -1) THEN 'unknown' ELSE NULL END AS problem FROM f GROUP BY episode_index")
def arr03_label_arrays(spark, sf):
    rows = frames(spark, sf).groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("frame_index", "raw_state"))).alias("x"))
    return rows.select("episode_index", records.label_array_problem(F.col("x.raw_state"), [0, 1, 2], 2).alias("problem"))


@query("SELECT l_orderkey, sha256(string_agg(sha256(l_partkey::VARCHAR), '' ORDER BY l_linenumber, sha256(l_partkey::VARCHAR))) AS digest FROM lineitem GROUP BY l_orderkey")
def hsh04_metadata_digest(spark, sf):
    return records.digest_of(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")


@query(f"WITH {FRAMES}, g AS (SELECT a.episode_index, a.frame_index, (SELECT arg_min(b.s0, (abs(b.t - (a.t + 30.0)), b.t)) FROM f b WHERE b.episode_index = a.episode_index AND abs(b.t - (a.t + 30.0)) <= 3600) AS later FROM f a) SELECT * FROM g")
def j16_nearest_in_time(spark, sf):
    return records.nearest(frames(spark, sf).select("episode_index", "frame_index", "t", "s0"), "t", "s0", 30.0, 3600.0, "later").select("episode_index", "frame_index", "later")
