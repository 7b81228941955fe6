"""Stores with atomic commits, appends by two writers and after a lost one, and statistics as merged states. Each query writes to a scratch folder of its own."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import functions as F

from framewright.operators import sampling, states
from framewright.plans.queries_storage import RECORDED, recorded
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, frames, state, table
from framewright.sources import arrays, commits
from framewright.sources import datasets as D
from framewright.sources import episodes as E
from framewright.sources import filesystem as fs
from framewright.sources.label_store import LabelStore
from framewright.sources.versioned import NotUnique, Table, VersionedStore

ORDERS = Table("id long, customer long, status string, price double", ("id",), (("customer", "id"),))


def together(*work) -> list[BaseException]:
    """Run functions at once, a thread each; what they raised."""
    failed: list[BaseException] = []

    def run(one) -> None:
        try:
            one()
        except BaseException as reason:
            failed.append(reason)

    threads = [threading.Thread(target=run, args=(w,)) for w in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return failed


def orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))


def ledger(spark, sf) -> VersionedStore:
    """Orders in two appends (versions 1, 2); dear ones are closed (3) and some are deleted (4)."""
    store, rows = VersionedStore.create(spark, fs.scratch(spark, "ledger"), {"orders": ORDERS}), orders(spark, sf)
    store.append(orders=rows.where("id % 3 = 0"))
    store.append(orders=rows.where("id % 3 <> 0"))
    store.write(orders=rows.where("price > 150000").withColumn("status", F.lit("closed")))
    store.write(orders=rows.where("id % 10 = 7").withColumn("_deleted", F.lit(True)))
    return store


_ORDERS = "SELECT o_orderkey::BIGINT AS id, o_custkey::BIGINT AS customer, {} AS status, o_totalprice::DOUBLE AS price FROM orders"


@query(_ORDERS.format("CASE WHEN o_totalprice > 150000 THEN 'closed' ELSE o_orderstatus END") + " WHERE o_orderkey % 10 <> 7")
def src17_versioned_snapshot(spark, sf):
    return ledger(spark, sf).snapshot("orders")


@query(_ORDERS.format("o_orderstatus"))
def src17_earlier_version(spark, sf):
    store = ledger(spark, sf)
    store.compact()
    return store.snapshot("orders", 2)


@query("SELECT o_orderkey::BIGINT AS id, o_orderkey % 10 = 7 AS deleted FROM orders WHERE o_orderkey % 10 = 7 UNION ALL SELECT o_orderkey, false FROM orders WHERE o_totalprice > 150000")
def src17_changes_since(spark, sf):
    return ledger(spark, sf).changes("orders", 2).select("id", F.col("_deleted").alias("deleted"))


@query("SELECT o_orderkey::BIGINT AS id, o_totalprice::DOUBLE AS price, 1 AS refused FROM orders")
def src17_two_writers(spark, sf):
    """Two writers append halves at once and both want the customers' first key: one of them is refused there, nothing is lost or doubled."""
    root, rows = fs.scratch(spark, "two-writers"), orders(spark, sf)
    VersionedStore.create(spark, root, {"orders": ORDERS})

    def writer(part: int):
        def run():
            mine = VersionedStore(spark, root)
            mine.append(orders=rows.where((F.col("id") % 4 > 0) & (F.col("id") % 2 == part)))
            mine.append(orders=rows.where("id % 4 = 0"))

        return run

    failed = together(writer(0), writer(1))
    if any(not isinstance(f, NotUnique) for f in failed):
        raise failed[0]
    return VersionedStore(spark, root).snapshot("orders").select("id", "price", F.lit(len(failed)).alias("refused"))


@query(_ORDERS.format("o_orderstatus") + " WHERE o_orderkey % 3 = 0")
def src17_killed_append(spark, sf):
    """A writer that stops after its rows were written and before its commit: readers and later writers never see them."""
    store, rows = VersionedStore.create(spark, fs.scratch(spark, "killed"), {"orders": ORDERS}), orders(spark, sf)
    store.append(orders=rows.where("id % 3 = 0"))
    store._stage(uuid.uuid4().hex, {"orders": rows})
    fresh = VersionedStore(spark, store.root)
    fresh.vacuum(grace=-1)
    return fresh.snapshot("orders")


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY user_id) AS task_id, user_id AS episode_index, count(*) AS length FROM events GROUP BY user_id)
SELECT task_id, episode_index, length AS end_frame, CASE WHEN task_id = 1 THEN 'completed' WHEN task_id = 2 THEN 'review' WHEN task_id IN (3, 4) THEN 'locked' ELSE 'pending' END AS status, CASE WHEN task_id = 2 THEN 2 ELSE 0 END::BIGINT AS skip_count FROM t""")
def stm12_stored_queue(spark, sf):
    """Tasks of all users; the first one is labelled, the second one skipped twice, two devices claim the next two at once."""
    queue = LabelStore.create(spark, fs.scratch(spark, "queue"))
    queue.add_tasks(1, table(spark, sf, "events").groupBy(F.col("user_id").alias("episode_index")).agg(F.count(F.lit(1)).alias("length")), 5, 0.0)
    first = queue.claim([1], "a", 1.0)
    queue.submit(first.task_id, "a", [0] * first.end_frame, 2.0)
    for now in (3.0, 5.0):
        queue.skip(queue.claim([1], "a", now).task_id, "a", now + 1)
    if failed := together(*[lambda d=d: LabelStore(VersionedStore(spark, queue.store.root)).claim([1], d, 7.0) for d in "ab"]):
        raise failed[0]
    return queue.store.snapshot("tasks").select("task_id", "episode_index", "end_frame", "status", "skip_count")


@query(f"WITH {RECORDED} SELECT event_id, frame_index, CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS task, (SELECT count(*) FROM g) AS n_indices, (SELECT count(*) - 1 FROM g) AS last_index, (SELECT count(*) FROM l) AS n_episodes FROM g")
def snk02_two_writers(spark, sf):
    """Two writers append episodes at once; one comes after the other, and indices have no gaps."""
    root, rows = fs.scratch(spark, "appended"), recorded(spark, sf)
    if failed := together(*[lambda name=name, part=part: D.append_episodes(rows.where(F.col("episode_index") % 2 == part), root, name, chunk_size=10) for part, name in enumerate(("even", "odd"))]):
        raise failed[0]
    names = F.create_map(*[F.lit(x) for pair in D.tasks_of(spark, root).items() for x in pair])
    found = E.read_frames(spark, root)
    totals = found.agg(F.countDistinct("index").alias("n_indices"), F.max("index").alias("last_index"), F.countDistinct("episode_index").alias("n_episodes"))
    return found.select("event_id", "frame_index", names[F.col("task_index")].alias("task")).join(F.broadcast(totals))


@query(f"WITH {RECORDED}, o AS (SELECT l.episode_index, length, CASE WHEN l.episode_index % 2 = 0 THEN 0 ELSE 1 END AS odd FROM l), n AS (SELECT episode_index, odd, length, row_number() OVER (ORDER BY odd, episode_index) - 1 AS new, (sum(length) OVER (ORDER BY odd, episode_index) - length)::BIGINT AS start FROM o) SELECT new AS episode_index, length, start AS from_index FROM n")
def snk02_recovered_append(spark, sf):
    """The second writer is lost after its commit and before anything is in place; the next one who looks finishes its change."""
    root, rows = fs.scratch(spark, "recovered"), recorded(spark, sf)
    D.append_episodes(rows.where("episode_index % 2 = 0"), root, "fold", chunk_size=10)
    D.append_episodes(rows.where("episode_index % 2 = 1"), root, "fold", chunk_size=10, publish=False)
    commits.recover(spark, root)
    return E.read_episodes(spark, root).select("episode_index", "length", "from_index")


@query(f"WITH {RECORDED}, a AS (SELECT start + frame_index AS index, episode_index, frame_index, event_id, s0, lead(s0) OVER (PARTITION BY episode_index ORDER BY frame_index) AS next_s0, lead(event_id) OVER (PARTITION BY episode_index ORDER BY frame_index) IS NULL AS is_terminal FROM g JOIN l USING (episode_index)), r AS (SELECT place, ('0x' || substr(md5('11:' || place), 1, 15))::BIGINT % (SELECT count(*) FROM g) AS index FROM (SELECT unnest(range(500)) AS place)) SELECT place, episode_index, frame_index, event_id, s0, next_s0, is_terminal FROM r JOIN a USING (index)")
def smp02_stored_batch(spark, sf):
    """A batch of 500 rows drawn from a stored dataset; only the files and row groups that hold them are read."""
    root, rows = fs.scratch(spark, "replay"), recorded(spark, sf)
    D.append_episodes(rows, root, "fold", chunk_size=10)
    total = E.read_info(spark, root).first().total_frames
    requests = spark.range(500).select(F.col("id").alias("place"), (sampling.draw(11, "id") % total).alias("index"))
    found = D.gather_stored(spark, root, requests, ["event_id", "state"])
    return found.select("place", "episode_index", "frame_index", "event_id", F.col("state")[0].alias("s0"), F.col("next_state")[0].alias("next_s0"), "is_terminal")


_WHOLE = "count(x)::BIGINT AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max"


@query(f"WITH {RECORDED}, e AS (SELECT 0 AS dim, s0 AS x FROM g UNION ALL SELECT 1, s1 FROM g) SELECT dim, {_WHOLE} FROM e WHERE x IS NOT NULL GROUP BY dim")
def snk02_statistics_after_append(spark, sf):
    """Three appends, each with its own states; the dataset's statistics are merged from them."""
    root, rows = fs.scratch(spark, "statistics"), recorded(spark, sf)
    for part in range(3):
        D.append_episodes(rows.where(F.col("episode_index") % 3 == part), root, "fold", chunk_size=10)
    return D.dataset_statistics(spark, root).where("feature = 'state'").select("dim", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query(f"WITH {FRAMES}, e AS (SELECT 0 AS dim, s0 AS x FROM f UNION ALL SELECT 1, s1 FROM f) SELECT dim, {_WHOLE} FROM e WHERE x IS NOT NULL GROUP BY dim")
def agg01_merged_states(spark, sf):
    """States of two halves, taken apart and merged by threes."""
    df = state(frames(spark, sf)).select("episode_index", "frame_index", "state")
    halves = [states.partial_states(df.where(F.col("episode_index") % 2 == part)) for part in (0, 1)]
    merged = states.merge_states(halves[0].unionByName(halves[1]), ["feature", "dim"], fan=3)
    return states.with_statistics(merged, {}).select("dim", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query(f"WITH {FRAMES}, e AS (SELECT 0 AS dim, s0 AS x FROM f UNION ALL SELECT 1, s1 FROM f) SELECT dim, level, count(x)::BIGINT AS n, true AS within FROM e, (SELECT unnest(['q01', 'q50', 'q99']) AS level) WHERE x IS NOT NULL GROUP BY dim, level")
def agg02_merged_quantiles(spark, sf):
    """Quantiles of states of 64 points, merged by eights: whether each is as near to its rank as its state promises."""
    levels = {"q01": 0.01, "q50": 0.5, "q99": 0.99}
    df = state(frames(spark, sf)).select("episode_index", "frame_index", "state")
    merged = states.with_statistics(states.merge_states(states.partial_states(df, size=64), ["feature", "dim"], 64, 8), levels)
    found = merged.select("dim", "n", "error", F.explode(F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*levels))).alias("level", "v"), F.lit(1).alias("one"))
    values = states.elements(df).select("dim", "x")
    counted = values.join(F.broadcast(found), "dim").groupBy("dim", "level", "n", "error", "v").agg(F.sum((F.col("x") < F.col("v")).cast("long")).alias("below"), F.sum((F.col("x") <= F.col("v")).cast("long")).alias("upto"))
    rank = F.ceil(F.col("n") * F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[F.col("level")])
    return counted.select("dim", "level", "n", ((rank >= F.col("below") + 1 - F.col("error")) & (rank <= F.col("upto") + F.col("error"))).alias("within"))


@query("SELECT vec_id, label, embedding FROM embeddings WHERE vec_id >= 37 AND vec_id < (SELECT max(vec_id) - 50 FROM embeddings)", vectors=("embedding",))
def src18_array_shards(spark, sf):
    """Embeddings written as arrays of 128 rows a shard, digests and all, and read by a range of the index."""
    rows, root = table(spark, sf, "embeddings"), fs.scratch(spark, "arrays")
    n = arrays.write_arrays(rows, root, "vec_id", ["embedding", "label"], 128)
    arrays.register(spark)
    found = spark.read.format("array_shards").option("path", root).load().where((F.col("index") >= 37) & (F.col("index") < n - 51))
    return found.select(F.col("index").alias("vec_id"), "label", "embedding")
