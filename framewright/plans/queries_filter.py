"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import vectors as V
from framewright.operators import windows
from framewright.plans import transforms
from framewright.plans.queries_aggregate import ISLANDS, MEDIAN, median_dt
from framewright.plans.queries_sequence import NUMBERED
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, episodes, frames, state, table


@query("SELECT event_id, value AS s0, user_id AS who FROM events")
def prj01_repack(spark, sf):
    nested = table(spark, sf, "events").select("event_id", F.struct(F.struct("value", "user_id").alias("inner")).alias("outer"))
    return transforms.repack(nested, {"event_id": "event_id", "s0": "outer/inner/value", "who": "outer/inner/user_id"})


@query("SELECT c_custkey AS \"id\", c_name AS \"who/name\", c_acctbal AS \"who/money/balance\" FROM customer")
def prj02_flatten(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("money")).alias("who"))
    return transforms.flatten(c)


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal FROM customer")
def prj03_rename(spark, sf):
    return transforms.rename(table(spark, sf, "customer"), {"c_(cust)?(key|name)": r"\2", "c_acctbal": "bal", "c_.*": None})


@query("SELECT p_partkey, round(p_retailprice * 2, 4) AS p_retailprice, p_size * 2 AS p_size FROM part")
def prj04_apply_tree(spark, sf):
    return transforms.apply_columns(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], lambda c: F.round(c * 2, 4)).withColumn("p_size", F.col("p_size").cast("int"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'be careful') AS prompt FROM orders")
def prj06_default_prompt(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("prompt"))
    return transforms.default_prompt(o, "be careful")


@query(f"WITH {FRAMES} SELECT episode_index, frame_index, [s0, s1, 0.0, 0.0]::DOUBLE[] AS v FROM f", vectors=("v",))
def prj07_pad(spark, sf):
    return state(frames(spark, sf)).select("episode_index", "frame_index", V.pad("state", 4).alias("v"))


@query("SELECT vec_id, embedding[1:7] AS v FROM embeddings", vectors=("v",))
def prj08_truncate(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.truncate("embedding", 7).alias("v"))


@query("SELECT vec_id, list_transform(range(1, 65, 3), lambda i: embedding[i]) AS v FROM embeddings", vectors=("v",))
def prj09_subsample(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.subsample("embedding", 3).alias("v"))


@query(f"WITH {FRAMES} SELECT episode_index, frame_index, [s0, s1, t]::DOUBLE[] AS v FROM f", vectors=("v",))
def prj10_assemble(spark, sf):
    return state(frames(spark, sf)).select("episode_index", "frame_index", F.concat("state", F.array("t")).alias("v"))


@query("SELECT vec_id, list_concat([embedding[3]], [embedding[2]], [embedding[1]], embedding[4:64]) AS v FROM embeddings", vectors=("v",))
def prj11_swap(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.swap("embedding", 0, 2).alias("v"))


@query("SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS mask, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0 END AS image FROM orders")
def prj12_missing_camera(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.create_map(F.col("o_orderpriority"), F.col("o_totalprice")).alias("images"))
    has = F.map_contains_key("images", F.lit("1-URGENT")) | F.map_contains_key("images", F.lit("2-HIGH"))
    return o.select("o_orderkey", has.alias("mask"), F.coalesce(F.try_element_at("images", F.lit("1-URGENT")), F.try_element_at("images", F.lit("2-HIGH")), F.lit(0.0)).alias("image"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def prj13_remove_strings(spark, sf):
    return transforms.drop_strings(table(spark, sf, "part"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS v FROM events")
def prj16_path_fallback(spark, sf):
    read = F.coalesce(*[F.get_json_object("props", p).try_cast("double") for p in ("$.missing", "$.k")])
    return table(spark, sf, "events").select("event_id", read.alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, l_extendedprice, l_discount] AS v, true AS finite FROM lineitem", vectors=("v",))
def prj17_ordered_vector(spark, sf):
    vec = F.array("l_quantity", "l_extendedprice", "l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", vec.alias("v"), V.is_valid_vector(vec, 3).alias("finite"))


@query(f"WITH {FRAMES} SELECT episode_index, length FROM ep WHERE length / 30.0 BETWEEN 2 AND 2.3")
def flt01_duration_inclusive(spark, sf):
    return episodes(frames(spark, sf)).where((F.col("length") / 30).between(2, 2.3)).select("episode_index", "length")


@query(f"WITH {FRAMES}, {MEDIAN} SELECT episode_index FROM ep JOIN md USING (episode_index) WHERE t_last - t_first + median_dt > 2400000 AND t_last - t_first + median_dt < 2520000")
def flt02_duration_exclusive(spark, sf):
    df = frames(spark, sf)
    duration = F.col("t_last") - F.col("t_first") + F.col("median_dt")
    return episodes(df).join(median_dt(df), "episode_index").where((duration > 2_400_000) & (duration < 2_520_000)).select("episode_index")


STATIC = f"x AS (SELECT episode_index, frame_index, abs(s0 - lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index)) <= 25 AS still FROM f), {ISLANDS.format('still').replace('FROM f', 'FROM x')}, lr AS (SELECT episode_index, max(n_frames) AS n FROM r GROUP BY episode_index)"


@query(f"WITH {FRAMES}, {STATIC} SELECT ep.episode_index FROM ep LEFT JOIN lr ON lr.episode_index = ep.episode_index WHERE coalesce(n, 0) <= 6")
def flt03_static_run(spark, sf):
    moved = state(frames(spark, sf)).withColumn("before", F.lag("state").over(windows.in_order()))
    still = V.max_abs_difference(F.slice("state", 1, 1), F.slice("before", 1, 1)) <= 25
    return windows.longest_run(moved, still).where("longest_run <= 6").select("episode_index")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey NOT IN (3, 5, 8)")
def flt04_exclude_list(spark, sf):
    excluded = spark.createDataFrame([(3,), (5,), (8,)], "c_nationkey int")
    return table(spark, sf, "customer").join(F.broadcast(excluded), "c_nationkey", "left_anti").select("c_custkey", "c_name")


@query(f"WITH {FRAMES}, {NUMBERED} SELECT episode_index, new_episode FROM n WHERE new_episode NOT IN (0, 2, 5)")
def flt05_exclude_after_filter(spark, sf):
    kept = episodes(frames(spark, sf)).where("length >= 60").select("episode_index")
    return windows.dense_number(kept, "episode_index", "new_episode").where(~F.col("new_episode").isin(0, 2, 5))


@query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, '.*example.com.*')")
def flt06_path_match(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").rlike("^.*example.com.*$")).select("page_id", "url")


@query(f"""WITH {FRAMES}, mv AS (SELECT episode_index, frame_index, coalesce(abs(s0 - lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index)) >= 15, true) AS moved FROM f),
i1 AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM mv WHERE NOT moved), idle AS (SELECT episode_index, min(frame_index) AS s, max(frame_index) AS e FROM i1 GROUP BY episode_index, g HAVING count(*) >= 3),
act AS (SELECT mv.episode_index, frame_index FROM mv WHERE NOT EXISTS (SELECT 1 FROM idle WHERE idle.episode_index = mv.episode_index AND frame_index BETWEEN s AND e)),
i2 AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM act)
SELECT episode_index, min(frame_index) AS start_frame, max(frame_index) + 1 - 2 AS end_frame FROM i2 GROUP BY episode_index, g HAVING count(*) >= 6""")
def flt08_idle_ranges(spark, sf):
    df = frames(spark, sf).withColumn("moved", F.coalesce(F.abs(windows.first_difference("s0")) >= 15, F.lit(True)))
    return windows.idle_free_ranges(df, F.col("moved"), least_idle=3, least_kept=6, cut=2)


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND isfinite(value)")
def flt09_finite(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 4 = 1")
def flt10_dataset_predicate(spark, sf):
    return table(spark, sf, "events").where("user_id % 4 = 1").select("event_id")


@query(f"WITH {FRAMES} SELECT a.episode_index, a.frame_index FROM f a, range(0, 4) r(k), f b WHERE b.episode_index = a.episode_index AND b.frame_index = greatest(a.frame_index - 2 * k, 0) GROUP BY ALL HAVING bool_and(b.s0 > 10)")
def flt11_valid_window(spark, sf):
    df = frames(spark, sf).withColumn("h", windows.backward_window("s0", 3, 2))
    return df.where(F.forall("h", lambda x: x > 10)).select("episode_index", "frame_index")


@query(f"WITH {FRAMES}, {NUMBERED} SELECT episode_index, new_episode FROM n WHERE new_episode < 20")
def flt13_episode_limit(spark, sf):
    return windows.dense_number(episodes(frames(spark, sf)).where("length >= 60").select("episode_index"), "episode_index", "new_episode").where("new_episode < 20")


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS name FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax' FROM lineitem WHERE l_tax > 0.07")
def flt14_limit_violations(spark, sf):
    limits = {"l_discount": (0.0, 0.09), "l_tax": (0.0, 0.07)}
    bad = F.array_compact(F.array(*[F.when(~F.col(c).between(*lim), F.lit(c)) for c, lim in limits.items()]))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(bad).alias("name"))


@query("SELECT event_id, CASE WHEN value < 1 THEN 'value too small' END AS error FROM events")
def flt15_sample_health(spark, sf):
    checks = [F.when(F.col("value").isNull(), "no value"), F.when(F.isnan("value"), "not finite"), F.when(F.col("value") < 1, "value too small")]
    return table(spark, sf, "events").select("event_id", F.coalesce(*checks).alias("error"))


@query(f"WITH {FRAMES} SELECT episode_index, unnest(list_distinct([0, length // 2, greatest(0, length - 20)])) AS offset_ FROM ep")
def flt16_representative_offsets(spark, sf):
    n = F.col("length")
    spots = F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2), F.greatest(F.lit(0).cast("long"), n - 20)))
    return episodes(frames(spark, sf)).select("episode_index", F.explode(spots).alias("offset_"))


@query("SELECT event_id, event_type = 'click' AS intervention, event_type IN ('view', 'purchase') AS model_control FROM events")
def flt17_mode_flags(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("event_type") == "click").alias("intervention"), F.col("event_type").isin("view", "purchase").alias("model_control"))
