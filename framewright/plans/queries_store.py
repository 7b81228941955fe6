"""Sets, ordering, label store, ledger, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import images as images_
from framewright.operators import sampling, store
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, frames, state, table


@query("SELECT c_custkey AS key, c_name AS name, 0 AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier")
def set01_union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(0).alias("origin"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(1).alias("origin"))
    return a.unionByName(b)


@query("SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type")
def set02_dictionary_encode(spark, sf):
    return store.dictionary_encode(table(spark, sf, "events"), "event_type", "event_id")


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def set03_earliest_of_each(spark, sf):
    return store.first_of_each(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def set04_difference(spark, sf):
    return table(spark, sf, "labels").select("doc_id").distinct().join(table(spark, sf, "documents").where("doc_id % 3 = 0"), "doc_id", "left_anti")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set06_key_union(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf, "customer").select("c_custkey")).distinct()


@query("SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def set08_duplicate_fingerprints(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 4 = 0")
def set09_upsert(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = old.where("c_custkey % 4 = 0").withColumn("segment", F.lit("new"))
    added = changed.withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return store.upsert(old, changed.unionByName(added), ["c_custkey"])


@query("SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def set10_insert_or_ignore(spark, sf):
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return store.insert_or_ignore(old, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), ["k"])


@query("WITH a AS (SELECT p_name || p_partkey AS path, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_name || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_brand END AS v FROM part WHERE p_partkey % 4 <> 0) SELECT path, a.v AS old, b.v AS new FROM a FULL JOIN b USING (path) WHERE a.v IS DISTINCT FROM b.v")
def set11_contract_diff(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("value"))
    new = p.where("p_partkey % 4 <> 0").withColumn("value", F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("value")))
    return store.contract_diff(p.where("p_partkey % 3 <> 0"), new)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O') OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01')")
def flt12_claimable(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "locked").otherwise("completed")
    tasks = o.select("o_orderkey", status.alias("status"), F.col("o_orderdate").alias("locked_until"))
    return tasks.where(store.claimable(F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 5 AND count(*) OVER (PARTITION BY o_custkey) >= 5")
def srt03_earliest_if_enough(spark, sf):
    return store.earliest_if_enough(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 5, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1")
def srt04_claim_next(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderkey").limit(1).select("o_orderkey")


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stm12_latest_state(spark, sf):
    return store.latest_state(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type")


@query("SELECT event_id // 32 AS batch, list(event_id ORDER BY event_id) AS ids FROM events WHERE event_id // 32 < (SELECT count(*) // 32 FROM events) GROUP BY ALL", vectors=("ids",))
def smp04_smp05_batches(spark, sf):
    return sampling.batches(table(spark, sf, "events").select("event_id"), "event_id", 32).withColumnRenamed("items", "ids")


DRAW = "('0x' || substr(md5('{}:' || {}), 1, 15))::BIGINT"


@query(f"WITH {FRAMES}, r AS (SELECT event_id AS place, user_id AS episode_index, event_id % 7 AS frame_index FROM events) SELECT place, list_value(s0, s1) AS state, CASE WHEN nx IS NULL THEN list_value(0.0, 0.0) ELSE nx END AS next, nx IS NULL AS is_terminal FROM r JOIN (SELECT episode_index, frame_index, s0, s1, lead(list_value(s0, s1), 20) OVER (PARTITION BY episode_index ORDER BY frame_index) AS nx FROM f) USING (episode_index, frame_index)", vectors=("state", "next"))
def smp02_gather_in_order(spark, sf):
    requests = table(spark, sf, "events").select(F.col("event_id").alias("place"), F.col("user_id").alias("episode_index"), (F.col("event_id") % 7).alias("frame_index"))
    return sampling.gather(requests, state(frames(spark, sf)), "state", 20)


@query(f"SELECT place, event_id, value FROM (SELECT p.place, {DRAW.format(7, 'p.place')} % (SELECT count(*) FROM events) AS event_id FROM (SELECT unnest(range(1000)) AS place) p) JOIN events USING (event_id)")
def smp01_with_replacement(spark, sf):
    return sampling.with_replacement(table(spark, sf, "events").select("event_id", "value"), "event_id", 1000, seed=7)


@query(f"WITH p AS (SELECT user_id % 2 AS k, count(*) AS s, CASE user_id % 2 WHEN 0 THEN 0.25 ELSE 0.75 END AS w FROM events GROUP BY ALL), t AS (SELECT min(s / w) AS total FROM p) SELECT event_id FROM events JOIN p ON user_id % 2 = k, t WHERE {DRAW.format(7, 'event_id')} / 1152921504606846976.0 < least(1.0, total * w / s)")
def smp03_weighted_mix(spark, sf):
    parts = [table(spark, sf, "events").where(F.col("user_id") % 2 == k).select("event_id") for k in (0, 1)]
    return sampling.weighted_mix(parts, [0.25, 0.75], "event_id", seed=7)


@query(f"SELECT event_id, CASE {DRAW.format(3, 'event_id')} % 3 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR ELSE props END AS prompt FROM events")
def smp07_random_choice(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user"), "props")
    return e.select("event_id", sampling.choice(["event_type", "user", "props"], "event_id", seed=3).alias("prompt"))


@query(f"SELECT event_id FROM events ORDER BY {DRAW.format(7, 'event_id')}, event_id LIMIT 500")
def smp09_capped_subset(spark, sf):
    return sampling.shuffled_subset(table(spark, sf, "events").select("event_id"), 500, "event_id", seed=7)


@query(f"SELECT vec_id, dropped, CASE WHEN dropped THEN list_transform(embedding, lambda x: 0.0::FLOAT) ELSE embedding END AS chunk FROM (SELECT *, {DRAW.format(5, 'vec_id')} / 1152921504606846976.0 < 0.3 AS dropped FROM embeddings)", vectors=("chunk",))
def scl25_chunk_dropout(spark, sf):
    chunk, dropped = sampling.chunk_dropout("embedding", "vec_id", 0.3, seed=5)
    return table(spark, sf, "embeddings").select("vec_id", chunk.cast("array<float>").alias("chunk"), dropped.alias("dropped"))


_STEPS = f"b AS (SELECT event_id, e AS epoch, e * n + event_id AS step, n * 3 AS total FROM events, (SELECT count(*) AS n FROM events), (SELECT unnest(range(3)) AS e)), s AS (SELECT *, CASE WHEN step < 100 THEN step ELSE {DRAW.format(13, 'step')} % 100 END AS slot FROM b)"


@query(f"WITH {_STEPS} SELECT coalesce(lead(step) OVER (PARTITION BY slot ORDER BY step) - 100, total - 100 + slot)::BIGINT AS position, epoch, event_id FROM s")
def stm14_shuffle_buffer(spark, sf):
    """All events three times over, through a buffer of 100."""
    return sampling.shuffle_buffer(table(spark, sf, "events").select("event_id"), "event_id", 100, 13, 3)


_KERNEL = """k AS (SELECT o, i, floor(r / sum(r) OVER (PARTITION BY o) * 4194304 + 0.5)::BIGINT AS w FROM (SELECT o, i, greatest(0.0::DOUBLE, 1 - abs((i - c + 0.5) / 1.6::DOUBLE)) AS r FROM
 (SELECT o, i, (o + 0.5) * 1.6::DOUBLE AS c FROM (SELECT unnest(range(5)) AS o), (SELECT unnest(range(8)) AS i)) WHERE i >= greatest(0, trunc(c - 1.1::DOUBLE)) AND i < least(8, trunc(c + 2.1::DOUBLE))))"""


@query(f"""WITH e AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255, floor(255 * abs(v::DOUBLE)))::BIGINT AS p FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)), {_KERNEL},
h AS (SELECT vec_id, y, o AS x, (sum(p * w)::BIGINT + 2097152) // 4194304 AS p FROM e JOIN k ON e.x = k.i GROUP BY vec_id, y, o), v AS (SELECT vec_id, o AS y, x, (sum(p * w)::BIGINT + 2097152) // 4194304 AS p FROM h JOIN k ON h.y = k.i GROUP BY vec_id, o, x),
g AS (SELECT vec_id, i // 12 AS y, i % 12 AS x FROM embeddings, (SELECT unnest(range(60)) AS i))
SELECT vec_id, list(coalesce(p, 0)::INTEGER ORDER BY g.y, g.x) AS pixels FROM g LEFT JOIN (SELECT vec_id AS v_id, y AS v_y, x + 3 AS v_x, p FROM v) ON vec_id = v_id AND g.y = v_y AND g.x = v_x GROUP BY vec_id""", vectors=("pixels",))
def arr04_resize_with_pad(spark, sf):
    """Embeddings as images of 8 x 8, brought into 5 x 12."""
    images = table(spark, sf, "embeddings").select("vec_id", images_.to_bytes(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("pixels"))
    return images_.resized(images, "pixels", 8, 8, 1, 5, 12)
