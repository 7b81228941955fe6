"""Scalar functions over vectors, texts, hashes and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.functions import vectors as V
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, frames, state, table

MEAN, STD, LOW, HIGH = [50.0, 50.0, 9.0], [49.0, 29.0, 9.0], [0.0, 0.0], [200.0, 99.0]
F2 = f"WITH {FRAMES} SELECT episode_index, frame_index, "


def _frames(spark, sf, expr, digits=6):
    rounded = F.transform(expr, lambda x: F.round(x, digits) + 0.0)  # no negative zero
    return state(frames(spark, sf)).select("episode_index", "frame_index", rounded.alias("v"))


@query(F2 + "[round((s0 - 50) / (49 + 1e-6), 6), round((s1 - 50) / (29 + 1e-6), 6)] AS v FROM f", vectors=("v",))
def scl01_zscore(spark, sf):
    return _frames(spark, sf, V.zscore("state", MEAN, STD))


@query(F2 + "[round(s0 / (200 + 1e-6) * 2 - 1, 6) + 0.0, round(s1 / (99 + 1e-6) * 2 - 1, 6) + 0.0] AS v FROM f", vectors=("v",))
def scl02_quantile_scale(spark, sf):
    return _frames(spark, sf, V.quantile_scale("state", LOW, HIGH))


@query(F2 + "[round(s0 * (49 + 1e-6) + 50, 3), round(s1, 3)] AS v FROM f", vectors=("v",))
def scl03_inverse_zscore(spark, sf):
    return _frames(spark, sf, V.inverse_zscore("state", MEAN[:1], STD[:1]), 3)


@query(F2 + "[round((s0 + 1) / 2 * (200 + 1e-6), 6), round(s1, 6)] AS v FROM f", vectors=("v",))
def scl04_inverse_quantile(spark, sf):
    return _frames(spark, sf, V.inverse_quantile_scale("state", LOW[:1], HIGH[:1]))


@query(F2 + "[round((s0 - 50) / 49, 6), round((s1 - 50) / 1e-6, 6), 0.0, 0.0] AS v FROM f", vectors=("v",))
def scl05_floored_zscore(spark, sf):
    return _frames(spark, sf, V.floored_zscore("state", MEAN[:2], [49.0, 0.0], 4))


@query(F2 + "[round(s0 / 10 - s0, 6), round(s1 - s0, 6)] AS v FROM f", vectors=("v",))
def scl06_delta_actions(spark, sf):
    return _frames(spark, sf, V.delta("action", "state", V.bool_mask(1, -1)))


@query(F2 + "[round(s0 / 10 + s0, 6), round(s1 - s0 + s1, 6)] AS v FROM f", vectors=("v",))
def scl06_absolute_actions(spark, sf):
    return _frames(spark, sf, V.absolute("action", "state", V.bool_mask(2)))


@query("SELECT event_id, least(greatest(value, 5), 90) AS v FROM events")
def scl09_clip(spark, sf):
    return table(spark, sf, "events").select("event_id", V.clip("value", 5, 90).alias("v"))


@query("SELECT event_id, least(greatest(floor((value / 100 - 1 + 1) * 128), -1), 255)::INTEGER AS bin FROM events")
def scl10_bin256(spark, sf):
    return table(spark, sf, "events").select("event_id", V.bin256(F.col("value") / 100 - 1).alias("bin"))


@query("SELECT event_id, round(user_id / 256.0 * 2 - 1, 6) AS v FROM events")
def scl11_unbin(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(V.unbin("user_id"), 6).alias("v"))


@query("SELECT event_id, [event_id % 8, event_id // 8 % 5, event_id // 40 % 3] AS digits, event_id % 8 + event_id // 8 % 5 * 8 + event_id // 40 % 3 * 40 AS token FROM events", vectors=("digits",))
def scl12_mixed_radix(spark, sf):
    digits = V.token_to_digits("event_id", (8, 5, 3))
    return table(spark, sf, "events").select("event_id", digits.alias("digits"), V.digits_to_token(digits, (8, 5, 3)).alias("token"))


@query(F2 + "[s0, -s1] AS v FROM f", vectors=("v",))
def scl13_flip_signs(spark, sf):
    return state(frames(spark, sf)).select("episode_index", "frame_index", V.flip_signs("state", [1, -1]).alias("v"))


@query("SELECT event_id, round(asin(least(greatest(value / 500, -1), 1)), 9) AS angle FROM events")
def scl14_gripper_angle(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.asin(V.clip(F.col("value") / 500, -1.0, 1.0)), 9).alias("angle"))


@query("SELECT vec_id, CASE WHEN sqrt(1 - w * w) < 1e-9 THEN [0.0, 0.0, 0.0] ELSE list_transform(q, lambda x: round(x * 2 * acos(w) / sqrt(1 - w * w), 6)) END AS v FROM (SELECT vec_id, embedding[1:3]::DOUBLE[] AS q, least(greatest(embedding[4]::DOUBLE, -1), 1) AS w FROM embeddings)", vectors=("v",))
def scl15_axis_angle(spark, sf):
    v = V.quaternion_to_axis_angle(F.slice("embedding", 1, 4))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x, 6)).alias("v"))


@query("SELECT vec_id, list_transform(q, lambda x: round(x / sqrt(list_sum(list_transform(q, lambda y: y * y))), 6)) AS v FROM (SELECT vec_id, embedding[1:4]::DOUBLE[] AS q FROM embeddings)", vectors=("v",))
def scl16_unit_quaternion(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.unit_quaternion(F.slice("embedding", 1, 4)), lambda x: F.round(x, 6)).alias("v"))


@query("SELECT vec_id, list_transform(range(0, 30), lambda i: round(e[(i * 19 // 29 + 1)::INTEGER] + (e[least(i * 19 // 29 + 2, 20)::INTEGER] - e[(i * 19 // 29 + 1)::INTEGER]) * (i * 19 / 29.0 - i * 19 // 29), 6)) AS v FROM (SELECT vec_id, embedding[1:20]::DOUBLE[] AS e FROM embeddings)", vectors=("v",))
def scl17_resample(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.resample(F.slice("embedding", 1, 20), 30), lambda x: F.round(x, 6)).alias("v"))


@query("SELECT o_orderkey, o_orderkey * 1000000000 + greatest(10737418240, ceil(o_orderkey * 1000000000 / 5)::BIGINT) AS space FROM orders")
def scl18_required_space(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.required_space(F.col("o_orderkey") * 1_000_000_000).alias("space"))


@query("SELECT event_id, user_id * 5 AS critic, user_id * 5 // 2 AS actor FROM events")
def scl19_update_budget(spark, sf):
    return table(spark, sf, "events").select("event_id", X.update_budget("user_id", 5, 2).alias("b")).select("event_id", "b.*")


@query("SELECT vec_id, round(label + 0.99 * (1 - label % 2) * least(embedding[1], embedding[2])::DOUBLE, 6) AS target FROM embeddings")
def scl20_td_target(spark, sf):
    q = F.least(F.col("embedding")[0], F.col("embedding")[1]).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.col("label") + 0.99 * (1 - F.col("label") % 2) * q, 6).alias("target"))


@query("SELECT vec_id, list_transform(range(1, 33), lambda i: CASE WHEN i % 3 = 0 THEN embedding[i] ELSE embedding[i + 32] END) AS v FROM embeddings", vectors=("v",))
def scl22_bc_anchor(spark, sf):
    from framewright.operators.labels import anchored

    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("r"), F.array(*[F.lit(i % 3 == 0) for i in range(1, 33)]).alias("m"))
    return e.select("vec_id", anchored("x", "r", "m").alias("v"))


@query("""WITH RECURSIVE e AS (SELECT vec_id, embedding[1:5]::DOUBLE[] AS x FROM embeddings), r AS (SELECT vec_id, x, 1 AS i, x[1] AS v FROM e UNION ALL SELECT vec_id, x, i + 1, 0.8 * v + 0.6 * x[i + 1] FROM r WHERE i < 5)
SELECT vec_id, list(round(v, 6) ORDER BY i) AS v FROM r GROUP BY vec_id""", vectors=("v",))
def scl23_autoregressive(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.autoregressive(F.slice("embedding", 1, 5), 0.8), lambda x: F.round(x, 6)).alias("v"))


@query("SELECT vec_id, list_transform(range(1, 5), lambda i: round(embedding[i]::DOUBLE * 0.995 + embedding[i + 4]::DOUBLE * 0.005, 8)) AS v FROM embeddings", vectors=("v",))
def scl24_scl27_blend(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.blend(F.slice(e, 1, 4), F.slice(e, 5, 4), 0.995), lambda x: F.round(x, 8)).alias("v"))


@query("SELECT event_id, greatest(2, round_even(user_id * 20.0 / 30, 0))::BIGINT AS n FROM events")
def scl28_output_count(spark, sf):
    return table(spark, sf, "events").select("event_id", X.output_count("user_id", 20.0, 30.0).alias("n"))


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.001 * (event_id + 1) / 101 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(least((event_id - 100) / 900.0, 1) * pi())) END, 9) AS rate FROM events")
def scl29_schedule(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(X.schedule("event_id", 100, 0.001, 1000, 0.0001), 9).alias("rate"))


@query("SELECT doc_id, lower(translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '_' || chr(10), '  ')) AS prompt FROM documents")
def str01_clean_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_prompt("text").alias("prompt"))


@query("SELECT event_id, 'Task: ' || event_type || ', State: ' || user_id || ' ' || (user_id + 1) || ';' || chr(10) || 'Action: ' AS prompt FROM events")
def str02_prompt_format(spark, sf):
    return table(spark, sf, "events").select("event_id", X.format_prompt("event_type", F.array("user_id", F.col("user_id") + 1)).alias("prompt"))


@query("SELECT event_id, event_type AS action FROM events")
def str03_action_part(spark, sf):
    raw = F.concat(F.lit("Task: x;\nAction: "), F.col("event_type"), F.lit("|rest|"))
    return table(spark, sf, "events").select("event_id", X.action_part(raw).alias("action"))


@query("SELECT event_id, [event_id % 7, event_id % 5, 0, 0] AS tokens, [true, true, false, false] AS mask FROM events", vectors=("tokens", "mask"))
def str04_pad_tokens(spark, sf):
    t = F.array(F.col("event_id") % 7, F.col("event_id") % 5)
    return table(spark, sf, "events").select("event_id", X.pad_tokens(t, 4).cast("array<long>").alias("tokens"), X.token_mask(t, 4).alias("mask"))


@query("SELECT o_orderkey, printf('data/chunk-%03d/episode_%06d.parquet', o_orderkey // 1000, o_orderkey) AS path, o_orderkey AS parsed FROM orders")
def str05_str06_paths(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.episode_path("o_orderkey").alias("path")).withColumn("parsed", X.episode_of_path("path"))


@query("SELECT event_id, user_id || '--' || event_type || '--' || event_id AS step FROM events")
def str07_step_id(spark, sf):
    return table(spark, sf, "events").select("event_id", X.step_id("user_id", "event_type", "event_id").alias("step"))


@query("SELECT doc_id, true AS good, false AS bad FROM documents")
def str08_full_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_sha256(F.sha2("text", 256)).alias("good"), X.is_sha256("text").alias("bad"))


@query("SELECT event_id, strftime(ts + INTERVAL 300 SECONDS, '%Y-%m-%dT%H:%M:%SZ') AS until_ FROM events")
def dat01_lease_end(spark, sf):
    return table(spark, sf, "events").select("event_id", X.lease_end("ts").alias("until_"))


@query("SELECT event_id, 'batch_' || strftime(date_trunc('second', ts), '%Y%m%d_%H%M%S') AS batch FROM events")
def dat02_batch_id(spark, sf):
    ns = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) * 1000")
    return table(spark, sf, "events").select("event_id", X.batch_id(ns).alias("batch"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS sec, epoch_us(ts) % 1000000 * 1000 AS nanosec FROM events")
def dat04_seconds_nanos(spark, sf):
    ns = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) * 1000")
    return table(spark, sf, "events").select("event_id", X.seconds_and_nanos(ns).alias("x")).select("event_id", "x.*")


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS print FROM customer""")
def jsn01_canonical_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.fingerprint("c_name", "c_custkey").alias("print"))


@query("SELECT vec_id, [label, label + 1] AS back FROM embeddings", vectors=("back",))
def jsn03_json_list(spark, sf):
    coded = F.to_json(F.array(F.col("label"), F.col("label") + 1))
    return table(spark, sf, "embeddings").select("vec_id", F.from_json(coded, "array<int>").alias("back"))


@query("SELECT event_id, {'episode_index': user_id + 100, 'value': value}.episode_index AS episode_index, value FROM events")
def jsn04_nested_rewrite(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.struct(F.col("user_id").alias("episode_index"), "value").alias("m"))
    return e.withColumn("m", F.col("m").withField("episode_index", F.col("m.episode_index") + 100)).select("event_id", "m.*")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def hsh01_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(f"WITH {FRAMES} SELECT episode_index, sha256(string_agg(frame_index || ':' || raw_state || ':' || task, '|' ORDER BY frame_index)) AS print FROM f GROUP BY episode_index")
def hsh02_semantic_fingerprint(spark, sf):
    rows = frames(spark, sf).groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("frame_index", "raw_state", "task"))).alias("r"))
    line = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x.frame_index, x.raw_state, x.task)), "|")
    return rows.select("episode_index", F.sha2(line, 256).alias("print"))


@query("SELECT event_id, ('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT AS seed FROM events")
def hsh03_key_seed(spark, sf):
    return table(spark, sf, "events").select("event_id", X.seed_of("event_id").alias("seed"))


@query("SELECT vec_id, round(greatest(abs(embedding[1]::DOUBLE - embedding[4]::DOUBLE), abs(embedding[2]::DOUBLE - embedding[5]::DOUBLE), abs(embedding[3]::DOUBLE - embedding[6]::DOUBLE)), 8) AS m, len(embedding) = 64 AS valid FROM embeddings")
def arr01_arr02_max_abs(spark, sf):
    m = V.max_abs_difference(F.slice("embedding", 1, 3), F.slice("embedding", 4, 3))
    return table(spark, sf, "embeddings").select("vec_id", F.round(m, 8).alias("m"), V.is_valid_vector("embedding", 64).alias("valid"))


@query("SELECT n_nationkey, [n_name, 'front', 'zz'] AS keys FROM nation", vectors=("keys",))
def map02_preferred_order(spark, sf):
    keys, preferred = F.array(F.lit("zz"), F.col("n_name"), F.lit("front")), F.array(F.col("n_name"), F.lit("front"), F.lit("none"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_union(F.array_intersect(preferred, keys), keys).alias("keys"))
