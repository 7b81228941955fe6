"""What is written to storage and read again: datasets, metadata, documents, shards. Each query writes to a scratch folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators import datasets as O
from framewright.operators.windows import renumber_frames
from framewright.plans.registry import query
from framewright.plans.views import table
from framewright.sources import datasets as D
from framewright.sources import episodes as E
from framewright.sources import filesystem as fs
from framewright.sources import media as M
from framewright.sources import record_files as R
from framewright.sources.commits import open_store


def recorded(spark, sf) -> DataFrame:
    """All events as frames; users are episodes."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("episode_index"), "ts", "event_id", F.array("value", (F.col("event_id") % 16).cast("double")).alias("state"), (F.col("event_type") == "click").alias("intervention"))
    return renumber_frames(events, ["ts", "event_id"]).drop("ts")


RECORDED = f"g AS (SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, event_id, value AS s0, (event_id % 16)::DOUBLE AS s1, event_type = 'click' AS intervention, event_type FROM events), l AS (SELECT episode_index, count(*) AS length, row_number() OVER (ORDER BY episode_index) - 1 AS place, (sum(count(*)) OVER (ORDER BY episode_index) - count(*))::BIGINT AS start FROM g GROUP BY episode_index)"


def stored(spark, sf) -> str:
    root = fs.scratch(spark, "dataset")
    D.write_frames(recorded(spark, sf), root, chunk_size=10)
    D.write_metadata(spark, root, {0: "fold"}, chunk_size=10)
    return root


@query(f"WITH {RECORDED} SELECT episode_index, frame_index, event_id, start + frame_index AS index, s0, round((frame_index / 30.0)::FLOAT, 4) AS t FROM g JOIN l USING (episode_index)")
def snk01_snk18_src01_write_then_read(spark, sf):
    root = fs.scratch(spark, "frames")
    D.write_frames(recorded(spark, sf), root, chunk_size=10)
    return E.read_frames(spark, root).select("episode_index", "frame_index", "event_id", "index", F.col("state")[0].alias("s0"), F.round("timestamp", 4).alias("t"))


@query(f"WITH {RECORDED} SELECT episode_index, length, start AS from_index, start + length AS to_index, 'fold' AS task FROM l")
def snk04_src02_src06_episode_offsets(spark, sf):
    root = stored(spark, sf)
    return E.read_episodes(spark, root).select("episode_index", "length", "from_index", "to_index", F.col("tasks")[0].alias("task"))


@query(f"WITH {RECORDED} SELECT count(*) AS total_episodes, sum(length)::BIGINT AS total_frames, (count(*) - 1) // 10 + 1 AS total_chunks, 30.0::DOUBLE AS fps FROM l")
def snk04_src03_info(spark, sf):
    return E.read_info(spark, stored(spark, sf)).select("total_episodes", "total_frames", "total_chunks", "fps")


@query(f"WITH {RECORDED}, o AS (SELECT l.episode_index, length, CASE WHEN l.episode_index % 2 = 0 THEN 0 ELSE 1 END AS odd FROM l), n AS (SELECT episode_index, odd, row_number() OVER (ORDER BY odd, episode_index) - 1 AS new, (sum(length) OVER (ORDER BY odd, episode_index) - length)::BIGINT AS start FROM o) SELECT new AS episode_index, frame_index, start + frame_index AS index, event_id, odd::BIGINT AS task_index FROM g JOIN n USING (episode_index)")
def snk02_append(spark, sf):
    root, rows = fs.scratch(spark, "appended"), recorded(spark, sf)
    for task, part in (("fold", 0), ("pour", 1)):
        D.append_episodes(rows.where(F.col("episode_index") % 2 == part), root, task, chunk_size=10)
    return E.read_frames(spark, root).select("episode_index", "frame_index", "index", "event_id", "task_index")


@query(f"WITH {RECORDED}, k AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS new, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS start FROM l WHERE episode_index % 3 <> 1) SELECT new AS episode_index, frame_index, start + frame_index AS index, event_id FROM g JOIN k USING (episode_index)")
def snk03_remove_from_storage(spark, sf):
    root = stored(spark, sf)
    D.remove_episodes(spark, root, E.read_episodes(spark, root).where("episode_index % 3 = 1"), chunk_size=10)
    return E.read_frames(spark, root).select("episode_index", "frame_index", "index", "event_id")


@query(f"WITH {RECORDED} SELECT place + (SELECT count(*) FROM l) * copy AS episode_index, frame_index, start + frame_index + copy * (SELECT count(*) FROM g) AS index, event_id FROM g JOIN l USING (episode_index), (SELECT unnest(range(2)) AS copy)")
def snk12_merge_datasets(spark, sf):
    root, out = stored(spark, sf), fs.scratch(spark, "merged")
    D.merge_datasets(spark, [root, root], out, chunk_size=10)
    return E.read_frames(spark, out).select("episode_index", "frame_index", "index", "event_id")


@query(f"WITH {RECORDED} SELECT dataset_index, episode_index, length FROM l, (SELECT unnest(range(2)) AS dataset_index)")
def src07_src05_collection(spark, sf):
    top = fs.scratch(spark, "collection")
    for name in ("a", "b"):
        D.write_frames(recorded(spark, sf), f"{top}/{name}", chunk_size=10)
        D.write_metadata(spark, f"{top}/{name}", {0: name}, chunk_size=10)
    found = D.read_collection(spark, top)
    found.where("dataset_index = 1").select("episode_index", "length").write.parquet(f"{top}/b/meta/episodes/chunk-000/file-000.parquet")
    second = D.read_episode_files(spark, f"{top}/b").withColumn("dataset_index", F.lit(1))
    return found.where("dataset_index = 0").select("dataset_index", "episode_index", "length").unionByName(second).withColumn("dataset_index", F.col("dataset_index").cast("long"))


@query(f"WITH {RECORDED} SELECT episode_index, feature, dim, round(x, 6) AS mean, n AS count FROM (SELECT episode_index, 'state' AS feature, 0 AS dim, avg(s0) AS x, count(s0) AS n FROM g GROUP BY ALL UNION ALL SELECT episode_index, 'state', 1, avg(s1), count(s1) FROM g GROUP BY ALL)")
def snk04_episode_statistics(spark, sf):
    stats = D.episode_statistics(recorded(spark, sf)).select("episode_index", F.explode("stats").alias("feature", "s"))
    rows = stats.select("episode_index", "feature", F.posexplode(F.arrays_zip("s.mean", "s.count")).alias("dim", "v"))
    return rows.select("episode_index", "feature", F.col("dim").cast("long").alias("dim"), F.round("v.mean", 6).alias("mean"), F.col("v.count").alias("count"))


@query(f"WITH {RECORDED} SELECT episode_index, frame_index, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS raw_state FROM g")
def snk09_src08_label_document(spark, sf):
    label = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = recorded(spark, sf).join(table(spark, sf, "events").select("event_id", label.alias("label")), "event_id").select("episode_index", "frame_index", "label")
    path = fs.scratch(spark, "labels")
    return E.read_tristate(spark, f"{path}/{D.write_label_document(rows, path)}")


@query("SELECT event_id AS index, CASE WHEN value <= 200 THEN value / 200 END AS progress, 0 AS dataset_index, true AS valid_label FROM events")
def snk06_src09_progress(spark, sf):
    path = fs.scratch(spark, "progress")
    D.write_progress(table(spark, sf, "events").select(F.col("event_id").alias("index"), F.when(F.col("value") > 200, None).otherwise(F.col("value") / 200).alias("progress")), path, "events", {})
    return E.read_progress(spark, path)


@query("SELECT event_type AS key, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def snk07_src10_norm_stats(spark, sf):
    path = fs.scratch(spark, "norm")
    D.write_norm_stats(table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.array(F.avg("value")).alias("mean"), F.array(F.stddev_pop("value")).alias("std")), path)
    return D.read_norm_stats(spark, path).select("key", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("std")[0], 6).alias("std"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 'true' ELSE 'false' END AS flag, '[' || n_nationkey || ',' || n_regionkey || ']' AS keys FROM nation")
def snk08_annotation_export(spark, sf):
    path = fs.scratch(spark, "export")
    E.write_export(table(spark, sf, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") == 1).alias("flag"), F.array("n_nationkey", "n_regionkey").alias("keys")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "flag", "keys")


@query("SELECT n_nationkey, n_name, list_value(n_nationkey, n_regionkey) AS keys FROM nation", vectors=("keys",))
def snk05_src02_json_lines(spark, sf):
    path = fs.scratch(spark, "lines")
    D.write_lines(table(spark, sf, "nation").select("n_nationkey", "n_name", F.array("n_nationkey", "n_regionkey").cast("array<long>").alias("keys")), f"{path}/rows.jsonl", "n_nationkey")
    return E.read_json_lines(spark, f"{path}/rows.jsonl", "n_nationkey long, n_name string, keys array<long>")


@query("SELECT r_regionkey::BIGINT AS shard, (sum(n) OVER (ORDER BY r_regionkey) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY r_regionkey))::BIGINT AS stop FROM (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1)")
def snk10_snk11_publish(spark, sf):
    path, nation = fs.scratch(spark, "published"), table(spark, sf, "nation")
    for r in sorted(r[0] for r in nation.select("n_regionkey").distinct().collect()):  # a few shards, as in a catalog
        manifest = D.publish_shard(nation.where(F.col("n_regionkey") == r), f"{path}/shard-{r}", {"version": 1})
        D.publish_snapshot(spark, f"{path}/catalog.json", str(r), manifest["rows"], {"version": 1})
    shards = spark.read.option("multiLine", True).json(f"{path}/catalog.json").select(F.explode("shards").alias("s"))
    return shards.select(F.col("s.shard").cast("long").alias("shard"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("SELECT count(*) AS total, count_if(value > 50)::BIGINT AS kept, count_if(NOT value > 50)::BIGINT AS filtered FROM events")
def snk13_filter_report(spark, sf):
    path = fs.scratch(spark, "report")
    kept = F.col("value") > 50
    D.write_report(table(spark, sf, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered")), f"{path}/report.json")
    return spark.read.json(f"{path}/report.json").select("total", "kept", "filtered")


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 THEN user_id WHEN event_id % 5 = 2 THEN 7 WHEN event_id % 5 = 3 THEN 9 ELSE event_id % 11 END AS length FROM events")
def src04_episode_length(spark, sf):
    key = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", F.when(key % 5 < 2, F.col("user_id")).alias("length"), F.when(key % 5 <= 2, F.lit(7)).alias("num_frames"), F.when(key % 5 == 3, F.lit(9)).alias("episode_length"), F.lit(100).alias("dataset_from_index"), (key % 11 + 100).alias("dataset_to_index"))
    return E.with_length(rows).select("event_id", F.col("length").cast("long").alias("length"))


@query("SELECT event_id FROM events WHERE event_id % 40 BETWEEN 3 AND 8 OR event_id % 40 BETWEEN 20 AND 29")
def src16_keep_ranges_document(spark, sf):
    path = fs.scratch(spark, "keep")
    rows = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 40).alias("episode_index"), (F.col("event_id") % 40).alias("frame_index"))
    spans = F.explode(F.array(*[F.struct(F.lit(a).alias("start_frame"), F.lit(z).alias("end_frame")) for a, z in ((3, 9), (20, 30))]))
    D.write_keep_ranges(rows.select("episode_index").distinct().select(F.col("episode_index").alias("episode_key"), spans.alias("r")).select("episode_key", "r.*"), f"{path}/keep.json")
    keep = D.read_keep_ranges(spark, f"{path}/keep.json").withColumn("episode_index", F.col("episode_key").cast("long")).drop("episode_key")
    return O.keep_in_ranges(rows, keep).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity::FLOAT::DOUBLE AS l_quantity, l_extendedprice::FLOAT::DOUBLE AS l_extendedprice, l_returnflag, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS l_shipdate FROM lineitem")
def src11_record_files(spark, sf):
    """lineitem written as framed records and read again; times are stored as microseconds, a null is a feature that isn't there."""
    root = fs.scratch(spark, "records")
    R.register(spark)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", F.when(F.col("l_linestatus") == "O", F.expr("unix_micros(CAST(l_shipdate AS TIMESTAMP))")).alias("l_shipdate"))
    R.write_records(rows, root)
    found = spark.read.format("record_files").option("path", root).schema("l_orderkey long, l_linenumber int, l_quantity float, l_extendedprice float, l_returnflag string, l_shipdate long, reason string").load()
    shown = found.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_returnflag", F.expr("CAST(timestamp_micros(l_shipdate) AS TIMESTAMP_NTZ)").alias("l_shipdate"), "reason")
    return shown.withColumn("l_returnflag", F.when(F.col("reason").isNull(), F.col("l_returnflag")).otherwise(F.col("reason"))).drop("reason")


def damaged(files: DataFrame) -> DataFrame:
    """Of seven episodes in a row the fourth loses its file, the fifth its content, the sixth the box behind the media, the last that and a byte of media. media: bytes of it. Run once, by tasks."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                store, at = open_store(row["path"])
                kept = {3: None, 4: 0, 5: 36 + row["media"], 6: 35 + row["media"]}.get(row["episode_index"] % 7, -1)
                if kept is None:
                    store.delete_file(at)
                elif kept >= 0:
                    with store.open_input_stream(at) as file:
                        content = file.read(kept)
                    with store.open_output_stream(at) as file:
                        file.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("episode_index"), batch.column("path")], names=["episode_index", "path"])

    return fs.stored(files.mapInArrow(run, "episode_index long, path string"), "damaged")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) // 10000 AS c FROM events) SELECT user_id AS episode_index, CASE user_id % 7 WHEN 3 THEN 'missing' WHEN 4 THEN 'empty' WHEN 5 THEN 'no moov box in file' WHEN 6 THEN 'mdat at 20 ends 1 bytes behind file' END AS error,
CASE WHEN user_id % 7 < 3 THEN (max(c) - min(c)) / 100.0 END AS duration, CASE WHEN user_id % 7 < 3 THEN count(*) END AS frames, user_id % 7 < 3 AS ok FROM s GROUP BY user_id""")
def dq16_media_check(spark, sf):
    """Every user's events as samples of one file of boxes; four of seven files are damaged, each in its own way, and are found."""
    root = fs.scratch(spark, "videos")
    hundredths = F.expr("unix_millis(CAST(ts AS TIMESTAMP)) DIV 10")
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "props", hundredths.alias("c"))
    lasting = events.withColumn("lasts", F.lead("c").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("c"))
    files = M.write_media(lasting, root, "user_id", ["ts", "event_id"], "props", "lasts", 100, "json", 1, 1)
    media = events.groupBy(F.col("user_id").alias("episode_index")).agg(F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).cast("long").alias("media"))
    checked = M.check_media(damaged(files.join(media, "episode_index")))
    return checked.select("episode_index", "error", "duration", "frames", "ok")
