"""Checks and look-ups over bookkeeping records: segments, totals, manifests, ordered keys, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bad_segments(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """Inclusive segments (episode_index, start_frame, end_frame) that are reversed, reach outside their episode or belong to no episode."""
    placed = segments.join(episodes.select("episode_index", "length"), "episode_index", "left")
    good = (F.col("start_frame") >= 0) & (F.col("start_frame") <= F.col("end_frame")) & (F.col("end_frame") < F.col("length"))
    return placed.where(~F.coalesce(good, F.lit(False))).select("episode_index", "start_frame", "end_frame", "length")


def bad_targets(manifest: DataFrame, order: str, unique: list[str]) -> DataFrame:
    """reason, n: how many rows repeat a value that must be unique, and whether ``order`` isn't 0, 1, ... without gaps. Aggregates only; no global order."""
    repeated = [manifest.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.sum("n").alias("n")).select(F.lit(f"repeated {c}").alias("reason"), "n") for c in unique]
    n = F.count(F.lit(1))
    gaps = manifest.agg(n.alias("rows"), F.min(order).alias("low"), F.max(order).alias("high")).where("low <> 0 OR high <> rows - 1").select(F.lit(f"gaps in {order}").alias("reason"), F.col("rows").alias("n"))
    for part in repeated:
        gaps = gaps.unionByName(part)
    return gaps.where("n > 0")


def clamped_ahead(frames: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """``out`` is the value k frames later, or the episode's last."""
    ordered = Window.partitionBy("episode_index").orderBy("frame_index")
    last = F.last(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return frames.withColumn(out, F.when(F.lead(F.lit(True), k).over(ordered).isNull(), last).otherwise(F.lead(value, k).over(ordered)))


def nearest(frames: DataFrame, time: str, value: str, offset: float, tolerance: float, out: str) -> DataFrame:
    """``out`` is the episode's value whose time is nearest to time + offset, the earlier on a tie, null beyond the tolerance. One sort of a union by episode."""
    seen = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    asked = frames.withColumns({"_at": F.col(time) + offset, "_side": F.lit(1), "_seen": F.lit(None).cast(frames.select(seen.alias("x")).schema[0].dataType)})
    told = frames.select("episode_index", F.col(time).alias("_at"), F.lit(0).alias("_side"), seen.alias("_seen"))
    w = Window.partitionBy("episode_index").orderBy("_at", "_side")
    both = asked.unionByName(told, allowMissingColumns=True).withColumns({
        "_before": F.last("_seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_seen", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    back, ahead = F.col("_at") - F.col("_before.t"), F.col("_after.t") - F.col("_at")
    take_back = F.col("_after").isNull() | (back <= ahead)
    best = F.when(take_back & (back <= tolerance), F.col("_before.v")).when(~F.coalesce(take_back & F.col("_before").isNotNull(), F.lit(False)) & (ahead <= tolerance), F.col("_after.v"))
    return both.where("_side = 1").withColumn(out, best).drop("_at", "_side", "_seen", "_before", "_after")


def unsorted_keys(df: DataFrame, group: str, key: str) -> DataFrame:
    """Rows whose key isn't larger than the one before in the group's stored order ``pos``."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy("pos"))
    return df.withColumn("before", before).where(F.col(key) <= F.col("before"))


def union_of_states(first: DataFrame, second: DataFrame, key: str, state: str) -> DataFrame:
    """Every key of two scans with its state in each."""
    return first.select(key, F.col(state).alias("first")).join(second.select(key, F.col(state).alias("second")), key, "full_outer")


def alternating_mask(*counts: int) -> Column:
    """Positive counts are runs of true, negative ones of false, 0 is none."""
    runs = [F.array_repeat(F.lit(n > 0), abs(n)) for n in counts if n]
    return F.concat(*runs) if runs else F.array().cast("array<boolean>")


def is_zoned_iso(text: Column) -> Column:
    """An ISO date and time with a zone that names a real instant; null counts as not."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(shaped & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def label_array_problem(labels: Column, domain: list[int], terminal: int) -> Column:
    """null, unknown or misplaced for a label array that breaks a rule, else null: values are of the domain and a terminal one stands last only."""
    at = F.array_position(labels, terminal)
    known = F.forall(labels, lambda x: F.coalesce(x.isin(domain), F.lit(False)))
    return F.when(labels.isNull() | F.exists(labels, lambda x: x.isNull()), "null").when(~known, "unknown").when((at > 0) & (at < F.size(labels)), "misplaced")


def digest_of(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """One sha256 a group over its members' own sha256 in the given order. Meant for groups of bounded size, such as the files of one dataset."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.sha2(F.col(value).cast("string"), 256).alias("h")))), lambda x: x["h"])
    return df.groupBy(*group).agg(F.sha2(F.concat_ws("", parts), 256).alias("digest"))
