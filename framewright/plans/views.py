"""The episode data model over the synthetic tables: users are episodes, their events in time order are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_index, frame_index, t (seconds), s0, s1 (state), raw_state (label), intervention, task."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    number = F.row_number().over(order)
    last = F.lead("event_id").over(order).isNull()
    label = F.when(last & (F.col("user_id") % 3 == 0), 2).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    micros = F.expr("unix_micros(CAST(ts AS TIMESTAMP))")
    return events.select(F.col("user_id").alias("episode_index"), (number - 1).cast("long").alias("frame_index"), (micros / 1e6).alias("t"), F.col("value").alias("s0"), F.get_json_object("props", "$.k").cast("double").alias("s1"), label.alias("raw_state"), (F.col("event_type") == "click").alias("intervention"), F.col("event_type").alias("task"))


def state(df: DataFrame) -> DataFrame:
    return df.withColumns({"state": F.array("s0", "s1"), "action": F.array(F.col("s0") / 10, F.col("s1") - F.col("s0"))})


def episodes(df: DataFrame) -> DataFrame:
    return df.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


FRAMES = """f AS (SELECT user_id AS episode_index, row_number() OVER w - 1 AS frame_index, epoch_us(ts) / 1e6 AS t, value AS s0,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS s1,
  CASE WHEN lead(event_id) OVER w IS NULL AND user_id % 3 = 0 THEN 2 WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS raw_state,
  event_type = 'click' AS intervention, event_type AS task FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ep AS (SELECT episode_index, count(*) AS length, min(t) AS t_first, max(t) AS t_last FROM f GROUP BY episode_index)"""
