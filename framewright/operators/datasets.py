"""Checks and rewrites of whole episode datasets: totals, masks, schemas, catalogs, deletion, samplers, tracking messages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.joins import range_join
from framewright.operators.windows import dense_number, renumber_episodes


def total_differences(episodes: DataFrame, declared: dict[str, int]) -> DataFrame:
    """total, declared, found: those of total_episodes and total_frames that aren't what the episodes (episode_index, length) sum to."""
    found = episodes.agg(F.count(F.lit(1)).alias("total_episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_frames"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("total"), F.lit(n).cast("long").alias("declared"), F.col(name).cast("long").alias("found")) for name, n in declared.items()]))
    return found.select(rows.alias("r")).select("r.*").where("declared <> found")


def mask_differences(frames: DataFrame, segments: DataFrame, flag: str, width: int = 64) -> DataFrame:
    """Frames whose flag says otherwise than the half-open segments; a null flag is false."""
    covered = range_join(frames.select("episode_index", "frame_index"), segments, "frame_index", "start_frame", "end_frame", ["episode_index"], width, "left_semi")
    both = frames.join(covered.withColumn("_covered", F.lit(True)), ["episode_index", "frame_index"], "left")
    return both.where(F.coalesce("_covered", F.lit(False)) != F.coalesce(flag, F.lit(False))).drop("_covered")


def count_differences(rows: DataFrame, declared: DataFrame, key: str, count: str) -> DataFrame:
    """key, declared, found: keys whose number of rows isn't the declared one; either side may lack the key."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    both = declared.select(key, F.col(count).cast("long").alias("declared")).join(found, key, "full_outer")
    return both.where(~F.col("declared").eqNullSafe(F.col("found"))).select(key, "declared", "found")


def schema_differences(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """name, declared, found: columns whose type isn't the declared one, or that are on one side only. Reads the schema, no rows."""
    found = dict(df.dtypes)
    rows = [(n, declared.get(n), found.get(n)) for n in sorted({*declared, *found}) if declared.get(n) != found.get(n)]
    return df.sparkSession.createDataFrame(rows, "name string, declared string, found string")


def not_last(catalog: DataFrame, name: str, order: str, current: int) -> DataFrame:
    """One row with the catalog's last entry if that isn't the current one; an empty catalog has none."""
    return catalog.agg(F.max_by(name, order).alias("last")).select("last", F.lit(current).cast("long").alias("current")).where(~F.col("last").eqNullSafe(F.col("current")))


def matching_files(files: DataFrame, manifest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of files that the manifest lists with the same columns."""
    listed = manifest.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    return files.select(key, *columns).join(listed, key).where(same).select(key)


def misaligned(rows: DataFrame, others: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of both sides whose columns differ, such as an index that names another frame."""
    right = others.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return rows.select(key, *columns).join(right, key).where(differs).select(key)


def keep_in_ranges(frames: DataFrame, ranges: DataFrame | None, width: int = 64) -> DataFrame:
    """Frames inside their episode's half-open ranges (episode_index, start_frame, end_frame); all frames if there is no table of ranges."""
    return frames if ranges is None else range_join(frames, ranges, "frame_index", "start_frame", "end_frame", ["episode_index"], width, "left_semi")


def explode_ranges(df: DataFrame, ranges: str) -> DataFrame:
    """episode_index, start_frame, end_frame of a column of [start, end) pairs."""
    pairs = df.select("episode_index", F.explode(ranges).alias("_r"))
    return pairs.select("episode_index", F.col("_r")[0].alias("start_frame"), F.col("_r")[1].alias("end_frame"))


def delete_episodes(frames: DataFrame, episodes: DataFrame, gone: DataFrame) -> DataFrame:
    """frames without the episodes of ``gone``; the others move up (new_episode), with a gap-free index."""
    return renumber_episodes(frames, episodes.join(gone.select("episode_index").distinct(), "episode_index", "left_anti"))


def replay_catalog(frames: DataFrame) -> DataFrame:
    """episode_index, task of the first frame, n_frames."""
    return frames.groupBy("episode_index").agg(F.min_by("task", "frame_index").alias("task"), F.count(F.lit(1)).alias("n_frames"))


def distributed_share(df: DataFrame, key: str, world: int) -> DataFrame:
    """rank, position and key: rows are dealt in turn to ``world`` readers; the first ones are dealt again until all have the same number.

    ``key`` is a unique integer.
    """
    placed = dense_number(df.select(key), key, "position")
    n = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
    sized = placed.join(F.broadcast(n))
    more = sized.withColumn("position", F.col("_n") + F.col("position")).where(F.col("position") < F.ceil(F.col("_n") / world) * world)
    return sized.unionByName(more).select(key, "position", (F.col("position") % world).alias("rank"))


def to_batches(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key with its other columns as one list of structs, ordered. Meant for keys of bounded size, as batches are."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (*key, order)]))).alias("rows"))


def from_batches(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "rows"], F.explode("rows").alias("_r")).select(*[c for c in df.columns if c != "rows"], "_r.*")


def label_document_kind(df: DataFrame, group: str, label: str) -> DataFrame:
    """ready where every frame of the group has a label, else partial."""
    return df.groupBy(group).agg(F.when(F.bool_and(F.col(label).isNotNull()), "ready").otherwise("partial").alias("kind"))


def tracking_field(message: Column, function: str, field: str) -> Column:
    """A field of a message's ``value``, which is an object or the same as JSON text; null for other functions and text that is no JSON."""
    value = F.get_json_object(message, "$.value")
    return F.when(F.get_json_object(message, "$.functionName") == function, F.get_json_object(value, f"$.{field}"))


def route(command: Column, topics: dict[str, str], enabled: Column) -> Column:
    """The command's topic if it has one and is enabled."""
    out = F.lit(None).cast("string")
    for name, topic in topics.items():
        out = F.when(command == name, topic).otherwise(out)
    return F.when(F.coalesce(enabled, F.lit(False)), out)


def closest_name(text: Column, names: list[str]) -> Column:
    """The name with the smallest edit distance, the first in order on a tie; null for null."""
    ranked = F.array_sort(F.array(*[F.struct(F.levenshtein(text, F.lit(n)).alias("d"), F.lit(n).alias("name")) for n in names]))
    return F.when(text.isNotNull(), ranked[0]["name"])


def allowed_keys(mapping: Column, allowed: list[str]) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(mapping, lambda k, _: k.isin(allowed))))


def clipped_loss(mean: Column, anchor: Column, bound: float = 1.0) -> Column:
    """Sum of squared differences between a vector and another clipped to ±bound."""
    squares = F.zip_with(mean, anchor, lambda a, b: F.pow(a - F.greatest(F.lit(-bound), F.least(F.lit(bound), b)), F.lit(2.0)))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def _strict(text: str | None) -> bool:
    def once(pairs):
        if len(dict(pairs)) < len(pairs):
            raise ValueError("a key twice")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text, object_pairs_hook=once, parse_constant=refuse)
    except (TypeError, ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def is_strict_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON without repeated keys, NaN or infinities; Spark's own parser takes all three. Null is not."""
    for text in texts:
        yield text.map(_strict).astype(bool)
