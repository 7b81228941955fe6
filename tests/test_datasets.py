"""Small cases of the dataset operators: nulls, empty tables, block borders."""

import pandas as pd
from pyspark.sql import functions as F

from framewright.operators import datasets, quality
from framewright.operators.windows import BLOCK


def test_ranges_across_blocks(spark):
    rows = [(BLOCK - 2, 0, 5), (BLOCK - 1, 5, 9), (BLOCK, 9, 12), (3 * BLOCK, 13, 14), (3 * BLOCK + 1, 14, 15)]
    df = spark.createDataFrame(rows, "k long, s long, e long")
    assert [(r.k, r.expected) for r in quality.broken_ranges(df, "k", "s", "e").collect()] == [(3 * BLOCK, 12)]
    long = df.withColumn("n", F.when(F.col("k") == BLOCK, 4).otherwise(F.col("e") - F.col("s")))
    assert sorted(r.k for r in quality.broken_ranges(long, "k", "s", "e", "n").collect()) == [BLOCK, 3 * BLOCK]
    assert quality.broken_ranges(df.where("k < 0"), "k", "s", "e").isEmpty()


def test_keep_in_ranges(spark):
    df = spark.createDataFrame([(0, i) for i in range(6)] + [(1, 0), (None, 3)], "episode_index long, frame_index long")
    ranges = datasets.explode_ranges(spark.createDataFrame([(0, [[1, 3], [2, 4], [5, 5]]), (7, None)], "episode_index long, ranges array<array<long>>"), "ranges")
    assert sorted(r.frame_index for r in datasets.keep_in_ranges(df, ranges).collect()) == [1, 2, 3]
    assert datasets.keep_in_ranges(df, None).count() == 8
    assert datasets.keep_in_ranges(df, ranges.where("false")).count() == 0


def test_masks_totals_and_counts(spark):
    df = spark.createDataFrame([(0, 0, True), (0, 1, None), (0, 2, False)], "episode_index long, frame_index long, flag boolean")
    segments = spark.createDataFrame([(0, 1, 2)], "episode_index long, start_frame long, end_frame long")
    assert sorted(r.frame_index for r in datasets.mask_differences(df, segments, "flag").collect()) == [0, 1]
    empty = spark.createDataFrame([], "episode_index long, length long")
    assert datasets.total_differences(empty, {"total_episodes": 0, "total_frames": 0}).isEmpty()
    assert [tuple(r) for r in datasets.total_differences(empty, {"total_frames": 3}).collect()] == [("total_frames", 3, 0)]
    assert datasets.count_differences(df, spark.createDataFrame([(0, 3)], "episode_index long, n long"), "episode_index", "n").isEmpty()
    assert datasets.not_last(empty, "length", "episode_index", 1).first().last is None


def test_distributed_share_pads(spark):
    df = spark.createDataFrame([(5,), (7,), (11,)], "id long")
    got = sorted((r["rank"], r.position, r.id) for r in datasets.distributed_share(df, "id", 2).collect())
    assert got == [(0, 0, 5), (0, 2, 11), (1, 1, 7), (1, 3, 5)]
    assert datasets.distributed_share(df.where("id < 0"), "id", 2).isEmpty()


def test_text_helpers(spark):
    df = spark.createDataFrame([("clik",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(datasets.closest_name(F.col("x"), ["view", "click"])).collect()] == ["click", None, "view"]
    messages = spark.createDataFrame([('{"functionName":"T","value":{"x":1}}',), ('{"functionName":"T","value":"{\\"x\\":2}"}',), ('{"functionName":"U","value":{"x":3}}',), ("no json",), (None,)], "m string")
    assert [r[0] for r in messages.select(datasets.tracking_field(F.col("m"), "T", "x")).collect()] == ["1", "2", None, None, None]
    assert [datasets._strict(t) for t in ('{"a":1}', '{"a":1,"a":1}', "NaN", "[-Infinity]", "", None, "[" * 100000)] == [True] + [False] * 6
    assert list(pd.Series(["1", None]).map(datasets._strict)) == [True, False]


def test_delete_renumbers(spark):
    df = spark.createDataFrame([(e, i) for e, n in ((0, 2), (1, 3), (2, 1)) for i in range(n)], "episode_index long, frame_index long")
    eps = df.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    got = sorted((r.new_episode, r.frame_index, r["index"]) for r in datasets.delete_episodes(df, eps, eps.where("episode_index = 1")).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (1, 0, 2)]
    assert datasets.delete_episodes(df, eps, eps).isEmpty()
