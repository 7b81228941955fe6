"""Sessions, abort rules, leases, ticks, scans, contracts and sampled channel statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import vectors as V
from framewright.operators import joins, sessions, statistics
from framewright.plans import transforms
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, episodes, frames, table


@query("""WITH m AS (SELECT user_id AS source, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type IN ('view', 'click') THEN 'start' ELSE 'end' END AS kind, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS task FROM events),
k AS (SELECT *, lag(kind) OVER w AS before FROM m WHERE kind = 'end' OR trim(task) <> '' WINDOW w AS (PARTITION BY source ORDER BY t, kind, task)),
n AS (SELECT *, kind = 'start' AND coalesce(before, 'end') = 'end' AS started, sum(CASE WHEN kind = 'start' AND coalesce(before, 'end') = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t, kind, task ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM k)
SELECT source, episode::BIGINT AS episode, min(CASE WHEN started THEN task END) AS task, min(CASE WHEN started THEN t END) AS start_t, min(CASE WHEN kind = 'end' THEN t END) AS end_t FROM n WHERE started OR (kind = 'end' AND before = 'start') GROUP BY source, episode""")
def stm05_episode_sessions(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "start").otherwise("end")
    markers = table(spark, sf, "events").select(F.col("user_id").alias("source"), (F.expr("unix_micros(CAST(ts AS TIMESTAMP))") / 1e6).alias("t"), kind.alias("kind"), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type")).alias("task"))
    return sessions.episode_sessions(markers)


@query(f"""WITH {FRAMES}, a AS (SELECT episode_index, frame_index, CASE WHEN s0 > 150 THEN 'status' WHEN s1 > 9 THEN 'action' WHEN s0 IS NULL OR s0 * 0.001 > 0.08 THEN 'image' END AS st, s0 * 0.001 AS image_age FROM f),
b AS (SELECT *, sum((st = 'status')::INT) OVER w AS n1, sum((st = 'action')::INT) OVER w AS n2, sum((st = 'image')::INT) OVER w AS n3, count(image_age) OVER v AS c, avg(image_age) OVER v AS m FROM a WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY episode_index, st IS NULL ORDER BY frame_index ROWS 4 PRECEDING)),
c AS (SELECT *, CASE WHEN st IS NULL AND c = 5 AND m > 0.036 THEN 'abort average' WHEN st = 'image' AND n3 >= 4 THEN 'abort image' WHEN st = 'action' AND n2 >= 6 THEN 'abort action' WHEN st = 'status' AND n1 >= 3 THEN 'abort status' END AS ab FROM b),
d AS (SELECT *, min(CASE WHEN ab IS NOT NULL THEN frame_index END) OVER (PARTITION BY episode_index) AS e FROM c)
SELECT episode_index, frame_index, coalesce(ab, 'stale ' || st, 'ok') AS verdict FROM d WHERE e IS NULL OR frame_index <= e""")
def stm04_abort_rules(spark, sf):
    ticks = frames(spark, sf).select("episode_index", "frame_index", (F.col("s0") * 0.001).alias("status_age"), F.col("s1").alias("action_age"), (F.col("s0") * 0.001).alias("image_age"))
    return sessions.abort_rules(ticks, limits=(0.15, 9.0, 0.08), counts=(3, 6, 4), window=5, most=0.036).select("episode_index", "frame_index", "verdict")


@query("""WITH RECURSIVE e AS (SELECT user_id AS task_id, epoch_us(ts) / 1e9 AS t, ['claim', 'heartbeat', 'submit', 'skip', 'claim', 'claim', 'skip', 'heartbeat'][1 + event_id % 8] AS kind, 'd' || (event_id // 8) % 2 AS device, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT task_id, 0::BIGINT AS n, 'pending' AS status, NULL::VARCHAR AS owner, NULL::DOUBLE AS until, 0 AS skips, 0 AS refused FROM (SELECT DISTINCT task_id FROM e)
 UNION ALL SELECT r.task_id, e.n,
 CASE WHEN kind = 'claim' AND free THEN 'locked' WHEN kind = 'submit' AND owns THEN 'completed' WHEN kind = 'skip' AND owns THEN CASE WHEN skips + 1 >= 2 THEN 'review' ELSE 'pending' END ELSE status END,
 CASE WHEN kind = 'claim' AND free THEN device WHEN kind IN ('submit', 'skip') AND owns THEN NULL ELSE owner END,
 CASE WHEN kind = 'claim' AND free OR kind = 'heartbeat' AND owns THEN t + 300 WHEN kind IN ('submit', 'skip') AND owns THEN NULL ELSE until END,
 skips + CASE WHEN kind = 'skip' AND owns THEN 1 ELSE 0 END, refused + CASE WHEN (kind = 'claim' AND free) OR (kind <> 'claim' AND owns) THEN 0 ELSE 1 END
 FROM r JOIN (SELECT * FROM e) e ON e.task_id = r.task_id AND e.n = r.n + 1, LATERAL (SELECT status = 'pending' OR (status = 'locked' AND (until IS NULL OR until < t)) AS free, coalesce(owner = device, false) AND status = 'locked' AS owns))
SELECT task_id, status, owner, round(until, 6) AS until, skips, refused FROM r QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1""")
def stm12_lease_queue(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("claim", "heartbeat", "submit", "skip", "claim", "claim", "skip", "heartbeat")])
    log = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), (F.expr("unix_micros(CAST(ts AS TIMESTAMP))") / 1e9).alias("t"), F.col("event_id").alias("id"), kinds[(F.col("event_id") % 8).cast("int")].alias("kind"), F.concat(F.lit("d"), (F.floor(F.col("event_id") / 8) % 2).cast("string")).alias("device"))
    return sessions.lease_fold(log).withColumn("until", F.round("until", 6))


@query(f"WITH {FRAMES}, k AS (SELECT episode_index, t_first AS start_t, unnest(range(CAST(floor((t_last - t_first) / 250000.0) AS BIGINT) + 1)) AS i FROM ep) SELECT episode_index, round(tick, 3) AS t, round(s0, 6) AS s0 FROM (SELECT k.episode_index, start_t + i * 250000.0 AS tick, f.t AS seen, f.s0 FROM k ASOF JOIN f ON f.episode_index = k.episode_index AND start_t + i * 250000.0 >= f.t) WHERE tick - seen <= 200000.0 + 1e-12 AND s0 IS NOT NULL")
def stm03_tick_samples(spark, sf):
    df = frames(spark, sf)
    spans = episodes(df).select("episode_index", F.col("t_first").alias("start_t"), F.col("t_last").alias("end_t"))
    out = sessions.tick_samples(df.select("episode_index", "t", "s0"), spans, ["episode_index"], 250_000.0, "s0", 200_000.0)
    return out.select("episode_index", F.round("t", 3).alias("t"), F.round("s0", 6).alias("s0"))


@query("SELECT user_id, ts, event_id, value AS infer, lag(value * 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_total FROM events")
def stm15_response_times(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").alias("infer"), (F.col("value") * 2).alias("total"))
    return sessions.response_times(rows, "user_id", ["ts", "event_id"], "infer", "total")


SCANS = "a AS (SELECT p_name || '/' || p_partkey AS path, p_retailprice AS size FROM part WHERE p_partkey % 11 <> 3), b AS (SELECT p_name || '/' || p_partkey AS path, p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 13 <> 5)"


def scans(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_retailprice").alias("size"))
    return p.where("p_partkey % 11 <> 3"), p.where("p_partkey % 13 <> 5").withColumn("size", F.col("size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0))


@query(f"WITH {SCANS} SELECT path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' WHEN a.size = b.size THEN 'stable' ELSE 'busy' END AS verdict FROM a FULL JOIN b USING (path)")
def src22_scan_twice(spark, sf):
    return joins.compare_scans(*scans(spark, sf), "path", "size")


@query(f"WITH {SCANS} SELECT split_part(path, '/', 1) AS batch FROM a FULL JOIN b USING (path) GROUP BY 1 HAVING bool_and(a.size IS NOT NULL AND b.size IS NOT NULL AND a.size = b.size)")
def stm16_stable_twice(spark, sf):
    verdicts = joins.compare_scans(*scans(spark, sf), "path", "size")
    return verdicts.groupBy(F.split("path", "/")[0].alias("batch")).agg(F.bool_and(F.col("verdict") == "stable").alias("_ok")).where("_ok").select("batch")


@query(f"WITH {FRAMES}, g AS (SELECT episode_index, frame_index, s0, first_value(s0) OVER u AS a, last_value(s0) OVER u AS z, lead(s0, 3) OVER w AS n, lag(s0, 2) OVER w AS p FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index), u AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT episode_index, frame_index, list_value(CASE WHEN frame_index < 2 THEN a ELSE p END, s0, CASE WHEN frame_index + 3 >= (SELECT length FROM ep WHERE ep.episode_index = g.episode_index) THEN z ELSE n END) AS v, list_value(frame_index < 2, false, frame_index + 3 >= (SELECT length FROM ep WHERE ep.episode_index = g.episode_index)) AS is_pad FROM g", vectors=("v", "is_pad"))
def src15_time_offsets(spark, sf):
    from framewright.operators.windows import at_offsets

    return at_offsets(frames(spark, sf), "s0", [-2, 0, 3])


@query("SELECT c_custkey, bad FROM (SELECT c_custkey, list_filter(list_value(CASE WHEN c_custkey % 4 = 0 THEN 'fps' END, CASE WHEN c_custkey % 6 = 1 THEN 'robot_type' END, CASE WHEN c_custkey % 5 = 2 THEN 'features.state' END), lambda x: x IS NOT NULL) AS b FROM customer), LATERAL (SELECT array_to_string(b, ',') AS bad) WHERE len(b) > 0")
def dq22_append_contract(spark, sf):
    from framewright.operators.quality import contract_problems

    key = F.col("c_custkey")
    info = F.to_json(F.struct(F.when(key % 4 == 0, 15).otherwise(30).alias("fps"), F.when(key % 6 != 1, "arm").alias("robot_type"), F.struct(F.when(key % 5 == 2, "float64").otherwise("float32").alias("state")).alias("features")))
    known = {"fps": "30", "robot_type": "arm", "features.state": "float32"}
    return contract_problems(table(spark, sf, "customer").select("c_custkey", info.alias("info")), "info", known).select("c_custkey", F.array_join("bad", ",").alias("bad"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 5 IN (1, 3)")
def dq23_batch_metadata(spark, sf):
    from framewright.operators.quality import contract_problems

    key = F.col("n_nationkey")
    info = F.to_json(F.struct(F.when(key % 5 == 1, "data/{episode_index}.parquet").otherwise("data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet").alias("data_path"), F.struct(F.struct(F.lit("float32").alias("dtype"), F.array(F.when(key % 5 == 3, 14).otherwise(16)).alias("shape")).alias("state")).alias("features"), F.lit("v2.1").alias("codebase_version")))
    wanted = {"data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features.state.dtype": "float32", "features.state.shape": "[16]", "codebase_version": "v2.1"}
    return contract_problems(table(spark, sf, "nation").select("n_nationkey", info.alias("info")), "info", wanted).select("n_nationkey")


@query("WITH v AS (SELECT label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n, embedding FROM embeddings), k AS (SELECT DISTINCT video, n, CAST(floor(unnest(range(least(n, 10))) * (n - 1) / greatest(least(n, 10) - 1, 1)) AS BIGINT) AS i FROM (SELECT DISTINCT video, n FROM v)), p AS (SELECT v.video, v.i, unnest(range(len(embedding))) % 3 AS channel, unnest(embedding)::DOUBLE AS x FROM v JOIN k ON k.video = v.video AND k.i = v.i) SELECT video, channel, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(DISTINCT i) AS count FROM p GROUP BY video, channel")
def agg32_channel_statistics(spark, sf):
    order = Window.partitionBy("label").orderBy("vec_id")
    images = table(spark, sf, "embeddings").select(F.col("label").alias("video"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"), F.col("embedding").alias("pixels"))
    out = statistics.sampled_channels(images, "video", "pixels", 3, 10)
    return out.select("video", "channel", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")], "count")


@query("SELECT event_id, user_id AS observation_id, value AS observation_value FROM events")
def prj14_observation_only(spark, sf):
    wanted = {"observation_id": "user_id", "observation_value": "value", "actions": "props"}
    return transforms.repack(table(spark, sf, "events"), {"event_id": "event_id", **transforms.without(wanted, "actions")})


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'front,top' ELSE 'front' END AS videos, CASE WHEN n_nationkey % 2 = 0 THEN 'action,state' ELSE 'action,depth,state' END AS others FROM nation")
def prj15_feature_kinds(spark, sf):
    second = F.when(F.col("n_nationkey") % 2 == 0, F.lit('"top": {"dtype": "video"}')).otherwise(F.lit('"depth": {"dtype": "uint16"}'))
    features = F.concat(F.lit('{"state": {"dtype": "float32"}, "front": {"dtype": "video"}, "action": {"dtype": "float32"}, '), second, F.lit("}"))
    videos, others = transforms.features_by_kind(features, "video")
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(videos, ",").alias("videos"), F.array_join(others, ",").alias("others"))


@query("SELECT vec_id, list_transform(range(1, 17), lambda i: round(((embedding[i + 16]::DOUBLE - embedding[i]::DOUBLE) - (-0.5)) / (0.5 - (-0.5) + 1e-6) * 2 - 1, 5)) AS v FROM embeddings", vectors=("v",))
def scl26_executed_action(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.slice("embedding", 1, 16)).alias("state"), V.doubles(F.slice("embedding", 17, 16)).alias("action"))
    return e.select("vec_id", F.transform(V.executed_action("action", "state", [-0.5] * 16, [0.5] * 16), lambda x: F.round(x, 5)).alias("v"))


def samples(spark, sf, **columns):
    return table(spark, sf, "events").select("user_id", (F.expr("unix_micros(CAST(ts AS TIMESTAMP))") / 1e6).alias("t"), F.col("event_id").alias("id"), *[c.alias(n) for n, c in columns.items()])


@query("WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id AS id, event_id % 8 AS b, coalesce(lag(event_id % 8) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS was FROM events), x AS (SELECT *, unnest(range(3)) AS k FROM e) SELECT user_id, t, id, k AS button, (b >> k) & 1 = 1 AS pressed FROM x WHERE (b >> k) & 1 <> (was >> k) & 1")
def stm08_button_edges(spark, sf):
    return sessions.button_edges(samples(spark, sf, buttons=F.col("event_id") % 8), "user_id", ["t", "id"], "buttons", 3).withColumn("button", F.col("button").cast("long"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, (event_id % 9 // 3)::VARCHAR AS source, CASE WHEN event_id % 17 <> 0 THEN event_id % 4 <> 0 END AS l, event_id % 5 <> 0 AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT user_id, ts, event_id FROM events)),
z AS (SELECT user_id, 0::BIGINT AS n, true AS armed, NULL::DOUBLE AS since, NULL::DOUBLE AS last, NULL::VARCHAR AS source, NULL::DOUBLE AS fired FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT z.user_id, e.n,
 CASE WHEN bad OR (NOT l AND NOT r) THEN true WHEN NOT (l AND r) THEN a WHEN fires THEN false ELSE a END,
 CASE WHEN bad OR NOT (l AND r) THEN NULL ELSE start END, CASE WHEN NOT bad THEN t END, CASE WHEN NOT bad THEN e.source END, CASE WHEN NOT bad AND l AND r AND fires THEN t END
 FROM z JOIN e ON e.user_id = z.user_id AND e.n = z.n + 1, LATERAL (SELECT l IS NULL OR r IS NULL AS bad, z.last IS NOT NULL AND (t - z.last > 500000 + 1e-12 OR z.source IS DISTINCT FROM e.source) AS cleared), LATERAL (SELECT CASE WHEN cleared THEN true ELSE armed END AS a, coalesce(CASE WHEN NOT cleared THEN since END, t) AS start), LATERAL (SELECT a AND t - start >= 20000 - 1e-12 AS fires))
SELECT user_id, fired AS t FROM z WHERE fired IS NOT NULL""")
def stm09_stm10_dual_holds(spark, sf):
    key = F.col("event_id")
    rows = samples(spark, sf, source=F.floor(key % 9 / 3).cast("string"), left=F.when(key % 17 != 0, key % 4 != 0), right=key % 5 != 0)
    return sessions.dual_holds(rows, "user_id", 20_000.0, 500_000.0)


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id AS id, CASE WHEN event_type = 'error' THEN 'tick' ELSE event_type END AS kind FROM events),
s AS (SELECT *, last_value(CASE WHEN kind = 'click' THEN t END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN kind = 'view' THEN t END IGNORE NULLS) OVER w AS v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, (kind = 'tick')::INT, id ROWS UNBOUNDED PRECEDING))
SELECT user_id, t, id, CASE WHEN c IS NULL OR v IS NULL THEN 'missing ' || concat_ws(',', CASE WHEN c IS NULL THEN 'click' END, CASE WHEN v IS NULL THEN 'view' END) WHEN t - c > 300000 + 1e-12 OR t - v > 100000 + 1e-12 THEN 'stale ' || concat_ws(',', CASE WHEN t - c > 300000 + 1e-12 THEN 'click' END, CASE WHEN t - v > 100000 + 1e-12 THEN 'view' END) ELSE 'ok' END AS verdict FROM s WHERE kind = 'tick'""")
def stm01_stm02_freshness(spark, sf):
    kind = F.when(F.col("event_type") == "error", "tick").otherwise(F.col("event_type"))
    return sessions.input_verdicts(samples(spark, sf, kind=kind), "user_id", {"click": 300_000.0, "view": 100_000.0})
