"""Constraints as violation queries: each returns the rows that break one, none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.vectors import is_valid_vector
from framewright.operators.windows import BLOCK


def episode_count(episodes: DataFrame, expected: int) -> DataFrame:
    """One row with the counts if there aren't exactly the episodes 0..expected - 1."""
    got = episodes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("episode_index").alias("n_distinct"), F.min("episode_index").alias("low"), F.max("episode_index").alias("high"))
    good = (F.col("n") == expected) & (F.col("n_distinct") == expected) & (F.col("low") == 0) & (F.col("high") == expected - 1)
    return got.where(~F.coalesce(good, F.lit(False)))


def broken_ranges(ranges: DataFrame, order: str, start: str, end: str, length: str | None = None) -> DataFrame:
    """Ranges that don't begin where the one before ends, or, with ``length``, aren't that long. The one before may lie in another block of ``order``, so each block hands on its last end; no task sees all ranges."""
    blocked = ranges.withColumn("_block", F.floor(F.col(order) / BLOCK))
    last = blocked.groupBy("_block").agg(F.max_by(end, order).alias("_end"))
    handed = last.select("_block", F.lag("_end").over(Window.orderBy("_block")).alias("_handed"))  # one row a block
    inside = F.lag(end).over(Window.partitionBy("_block").orderBy(order))
    found = blocked.join(handed, "_block").withColumn("expected", F.coalesce(inside, "_handed", F.lit(0)))
    bad = (F.col(start) != F.col("expected")) | (F.col(end) < F.col(start))
    if length is not None:
        bad = bad | (F.col(end) != F.col(start) + F.col(length))
    return found.where(bad).drop("_block", "_handed")


def bad_labels(frames: DataFrame, label: str, domain: list[int], terminal: int) -> DataFrame:
    """Frames whose label is null or unknown, or a terminal label that isn't on the episode's last frame."""
    last = F.lead("frame_index").over(Window.partitionBy("episode_index").orderBy("frame_index")).isNull()
    bad = F.col(label).isNull() | ~F.col(label).isin(domain) | ((F.col(label) == terminal) & ~F.col("_last"))
    return frames.withColumn("_last", last).where(bad).drop("_last")


def broken_indices(frames: DataFrame) -> DataFrame:
    """Frames whose number isn't their place in the episode."""
    place = F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1
    return frames.withColumn("expected", place.cast("long")).where(F.col("frame_index").isNull() | (F.col("frame_index") != F.col("expected")))


def bad_vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    return df.where(~is_valid_vector(vector, width))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.isnan(column) | (F.col(column) < low) | (F.col(column) > high)))


def broken_links(rows: DataFrame, targets: DataFrame, key: Column, target: str) -> DataFrame:
    """Rows that point to nothing; a null key points nowhere on purpose."""
    keyed = rows.withColumn("_key", key).where("_key IS NOT NULL")
    return keyed.join(targets.select(F.col(target).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def manifest_differences(found: DataFrame, manifest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and reason of files that are missing, extra or differ."""
    a, b = found.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns], F.lit(1).alias("_f")), manifest.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns], F.lit(1).alias("_m"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"_f_{c}").eqNullSafe(F.col(f"_m_{c}"))
    reason = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "extra").when(differs, "differs")
    return a.join(b, key, "full_outer").select(key, reason.alias("reason")).where("reason IS NOT NULL")


def bad_norm_stats(stats: DataFrame) -> DataFrame:
    """dim, mean, std, q01, q99 that aren't finite or in order."""
    finite = F.lit(True)
    for c in ("mean", "std", "q01", "q99"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return stats.where(~(finite & (F.col("std") >= 0) & (F.col("q99") >= F.col("q01"))))


def contract_problems(df: DataFrame, info: str, wanted: dict[str, str]) -> DataFrame:
    """Rows whose JSON document doesn't have the wanted values (by dotted path, as text), with the paths that differ; a missing value differs."""
    wrong = [F.when(~F.get_json_object(F.col(info), f"$.{path}").eqNullSafe(F.lit(value)), path) for path, value in wanted.items()]
    return df.withColumn("bad", F.array_compact(F.array(*wrong))).where(F.size("bad") > 0)
