"""Labels to progress to sample weights to transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.windows import EPISODE, future_value, in_order, whole

DONE = 2


def cumulative_score(label: str, keys=EPISODE) -> Column:
    """Running sum of -1, 0 and 1; the completion label adds nothing."""
    return F.sum(F.when(F.col(label) == DONE, 0).otherwise(F.col(label))).over(in_order(keys).rowsBetween(Window.unboundedPreceding, 0)).cast("double")


def progress(df: DataFrame, label: str = "raw_state", keys=EPISODE) -> DataFrame:
    """progress in 0..0.99 by the episode's range of scores; a flat episode is 0; completion is 1."""
    scored = df.withColumn("_score", cumulative_score(label, keys))
    low, high = F.min("_score").over(whole(keys)), F.max("_score").over(whole(keys))
    scaled = F.when(high - low <= 1e-8, F.lit(0.0)).otherwise((F.col("_score") - low) / F.greatest(high - low, F.lit(1e-8)) * 0.99)
    return scored.withColumn("progress", F.when(F.col(label) == DONE, F.lit(1.0)).otherwise(scaled)).drop("_score")


def progress_deltas(df: DataFrame, k: int, keys=EPISODE) -> DataFrame:
    """delta: progress k frames on (clamped to the last) minus progress; null where either is."""
    return df.withColumn("delta", future_value("progress", k, keys) - F.col("progress"))


def delta_statistics(df: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """One row: mean, not below 0, and population std, not below epsilon; (0, epsilon) without rows."""
    clean = F.when(~F.isnan("delta"), F.col("delta"))
    return df.agg(F.greatest(F.coalesce(F.avg(clean), F.lit(0.0)), F.lit(0.0)).alias("mean"), F.greatest(F.coalesce(F.stddev_pop(clean), F.lit(epsilon)), F.lit(epsilon)).alias("std"))


def sample_weights(df: DataFrame, statistics: DataFrame, kappa: float, width: float = 2.0, fallback: float = 0.0) -> DataFrame:
    """1 above kappa; 0 at or below the lower edge or for deltas that aren't positive; in between the share of the way from mean - width std to mean + width std; the fallback for null or NaN.

    ``statistics`` is one row.
    """
    edge = (F.col("delta") - (F.col("mean") - width * F.col("std"))) / (2 * width * F.col("std"))
    d = F.col("delta")
    weight = F.when(d.isNull() | F.isnan(d), F.lit(fallback)).when(d > kappa, F.lit(1.0)).when(d <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(edge, F.lit(0.0)), F.lit(1.0)))
    return df.join(F.broadcast(statistics)).withColumn("weight", weight).drop("mean", "std")


def interval_targets(change: Column, epsilon: float) -> Column:
    return F.when(change > epsilon, 1).when(change < -epsilon, -1).otherwise(0)


def transition_starts(episodes: DataFrame, length: int = 20, stride: int = 2) -> DataFrame:
    """episode_index, start_frame, next_frame (-1 at the end), terminal: starts 0, stride, ... and always the last possible one."""
    last = F.col("length") - length
    starts = F.array_sort(F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))
    rows = episodes.where(F.col("length") >= length).withColumn("length", F.col("length").cast("long")).select("episode_index", "length", F.explode(starts).alias("start_frame"))
    terminal = F.col("start_frame") == last
    return rows.select("episode_index", "start_frame", F.when(terminal, F.lit(-1).cast("long")).otherwise(F.col("start_frame") + length).alias("next_frame"), terminal.alias("terminal"))


def chunk_reward(label: str, length: int = 20, keys=EPISODE) -> Column:
    """Undiscounted sum of the labels of this and the next length - 1 frames; null if there are fewer."""
    w = in_order(keys).rowsBetween(0, length - 1)
    return F.when(F.count(F.lit(1)).over(w) == length, F.sum(label).over(w))


def transitions(frames: DataFrame, episodes: DataFrame, length: int = 20, stride: int = 2) -> DataFrame:
    """Transition rows with reward; windows and starts meet on (episode, frame)."""
    rewards = frames.select("episode_index", F.col("frame_index").alias("start_frame"), chunk_reward("raw_state", length).alias("reward"))
    return transition_starts(episodes, length, stride).join(rewards, ["episode_index", "start_frame"])


def with_features(rows: DataFrame, features: DataFrame, feature: str) -> DataFrame:
    """Current and next feature of each transition; a terminal one has no next."""
    current = features.select("episode_index", F.col("frame_index").alias("start_frame"), F.col(feature).alias("current_feature"))
    following = features.select("episode_index", F.col("frame_index").alias("next_frame"), F.col(feature).alias("next_feature"))
    return rows.join(current, ["episode_index", "start_frame"]).join(following, ["episode_index", "next_frame"], "left")


def anchored(executed, reference, intervention) -> Column:
    """Each step's executed action where the operator intervened, else the reference."""
    ref = F.col(reference)
    mask = F.col(intervention)
    return F.transform(F.col(executed), lambda x, i: F.when(F.get(mask, i), x).otherwise(F.get(ref, i)))
