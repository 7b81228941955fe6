"""Sequence operators over frames: every window is partitioned by episode, so hot episodes are bounded by their own length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE = ("episode_index",)
BLOCK = 10_000


def in_order(keys=EPISODE, order="frame_index"):
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys=EPISODE, order="frame_index"):
    return in_order(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def renumber_frames(df: DataFrame, order: list, keys=EPISODE) -> DataFrame:
    """frame_index 0..n-1 in each episode."""
    return df.withColumn("frame_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def running_offset(df: DataFrame, key: str, size: str, out: str) -> DataFrame:
    """Sum of ``size`` over all smaller integer keys (unique), without one task for all rows: blocks of keys are summed apart, and only their totals meet."""
    blocked = df.withColumn("_block", F.floor(F.col(key) / BLOCK))
    totals = blocked.groupBy("_block").agg(F.sum(size).alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(totals, "_block").withColumn(out, (F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("long")).drop("_block", "_before")


def dense_number(df: DataFrame, key: str, out: str) -> DataFrame:
    """0, 1, 2, ... in the order of a unique integer key."""
    return running_offset(df.withColumn("_one", F.lit(1)), key, "_one", out).drop("_one")


def renumber_episodes(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """frames of the kept episodes (episode_index, length) with new_episode and a gap-free global index."""
    numbered = running_offset(dense_number(kept.select("episode_index", "length"), "episode_index", "new_episode"), "episode_index", "length", "offset")
    return frames.join(numbered.select("episode_index", "new_episode", "offset"), "episode_index").withColumn("index", F.col("offset") + F.col("frame_index")).drop("offset")


def forward_window(value: str | Column, horizon: int, keys=EPISODE) -> Column:
    """The next ``horizon`` values from this frame on; past the end the last one repeats."""
    v = F.col(value) if isinstance(value, str) else value
    got = F.collect_list(v).over(in_order(keys).rowsBetween(0, horizon - 1))
    return F.concat(got, F.array_repeat(F.element_at(got, -1), F.lit(horizon) - F.size(got)))


def backward_window(value: str, steps: int, gap: int, keys=EPISODE) -> Column:
    """Values at max(first, i - step * gap) for step = steps..0."""
    w = in_order(keys)
    first = F.first(value).over(whole(keys))
    number = F.row_number().over(w) - 1
    return F.array(*[F.when(number >= k * gap, F.lag(value, k * gap).over(w) if k else F.col(value)).otherwise(first) for k in range(steps, -1, -1)])


def future_value(value: str, k: int, keys=EPISODE) -> Column:
    """The value at min(i + k, last); frames are dense."""
    left = F.count(F.lit(1)).over(whole(keys)) - F.row_number().over(in_order(keys))
    return F.when(left >= k, F.lead(value, k).over(in_order(keys))).otherwise(F.last(value).over(whole(keys)))


def first_difference(value: str, keys=EPISODE) -> Column:
    return F.col(value) - F.lag(value).over(in_order(keys))


def runs(df: DataFrame, flag: Column, keys=EPISODE) -> DataFrame:
    """Half-open runs [start, end) of true flags in each episode."""
    w = in_order(keys)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_island", F.col("frame_index") - F.row_number().over(Window.partitionBy(*keys, "_flag").orderBy("frame_index")))
    return marked.where("_flag").groupBy(*keys, "_island").agg(F.min("frame_index").alias("start_frame"), (F.max("frame_index") + 1).alias("end_frame"), F.count(F.lit(1)).alias("n_frames")).drop("_island")


def value_runs(df: DataFrame, value: str, keys=EPISODE) -> DataFrame:
    """Half-open runs of equal values; a null belongs to no run and breaks one."""
    w = in_order(keys)
    change = (F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.lag("frame_index").over(w) == F.col("frame_index") - 1)).cast("int")
    numbered = df.withColumn("_new", 1 - F.coalesce(change, F.lit(0))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where(F.col(value).isNotNull()).groupBy(*keys, "_run").agg(F.min("frame_index").alias("start_frame"), (F.max("frame_index") + 1).alias("end_frame"), F.first(value).alias(value)).drop("_run")


def longest_run(df: DataFrame, flag: Column, keys=EPISODE) -> DataFrame:
    """Longest run of true flags of every episode, 0 if none."""
    found = runs(df, flag, keys).groupBy(*keys).agg(F.max("n_frames").alias("_n"))
    return df.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).cast("long").alias("longest_run"))


def idle_free_ranges(df: DataFrame, moved: Column, least_idle: int = 7, least_kept: int = 16, cut: int = 10, keys=EPISODE) -> DataFrame:
    """Ranges of frames without idle runs of least_idle or more; ranges of least_kept or more frames, without their last ``cut`` ones."""
    w = in_order(keys)
    still = ~F.coalesce(moved, F.lit(True))
    marked = df.select(*keys, "frame_index", still.alias("_still"))
    # frames are dense, so a run is told by its frames less their rank among still or moving ones
    marked = marked.withColumn("_run", F.col("frame_index") - F.row_number().over(Window.partitionBy(*keys, "_still").orderBy("frame_index")))
    sized = marked.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_still", "_run")))
    kept = runs(sized, ~(F.col("_still") & (F.col("_size") >= least_idle)), keys).where(F.col("n_frames") >= least_kept)
    return kept.select(*keys, "start_frame", (F.col("end_frame") - cut).alias("end_frame")).where("end_frame > start_frame")


def running_count(flag: Column, keys=EPISODE) -> Column:
    """Flags so far in the episode; a good frame in between doesn't reset them."""
    return F.sum(flag.cast("long")).over(in_order(keys).rowsBetween(Window.unboundedPreceding, 0))


def full_average(value: str, size: int, keys=EPISODE) -> Column:
    """Mean of the last ``size`` values, null until there are so many."""
    w = in_order(keys).rowsBetween(1 - size, 0)
    return F.when(F.count(value).over(w) == size, F.avg(value).over(w))


def at_offsets(df: DataFrame, value: str, offsets: list[int], keys=EPISODE) -> DataFrame:
    """keys, frame_index, the values ``offsets`` frames away (clamped to the episode) and is_pad, where that lies outside. Frames are dense, so an offset in seconds is one in frames."""
    w, u = in_order(keys), whole(keys)
    left, number = F.count(F.lit(1)).over(u) - F.row_number().over(w), F.row_number().over(w) - 1
    outside = [number < -k if k < 0 else left < k for k in offsets]
    edge = [F.first(value).over(u) if k < 0 else F.last(value).over(u) for k in offsets]
    moved = [F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k else F.col(value) for k in offsets]
    return df.select(*keys, "frame_index", F.array(*[F.when(o, e).otherwise(m) for o, e, m in zip(outside, edge, moved)]).alias("v"), F.array(*outside).alias("is_pad"))
