"""Label store, migration ledger and dataset bookkeeping as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.windows import dense_number


def status_counts(tasks: DataFrame, statuses: list[str], status: str = "status") -> DataFrame:
    """Every status with its count, 0 where there is none."""
    wanted = tasks.sparkSession.createDataFrame([(s,) for s in statuses], f"{status} string")
    return F.broadcast(wanted).join(tasks.groupBy(status).agg(F.count(F.lit(1)).alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def claimable(now: Column, excluded: int | None = None) -> Column:
    """Pending, or locked with a lease that has ended or never had one."""
    free = (F.col("status") == "pending") | ((F.col("status") == "locked") & (F.col("locked_until").isNull() | (F.col("locked_until") < now)))
    return free & (F.col("task_id") != excluded) if excluded is not None else free


def earliest_if_enough(df: DataFrame, n: int, order: list[str], group: list[str]) -> DataFrame:
    """The first n rows of each group by the given order, only for groups with n rows or more."""
    ranked = df.withColumns({"_rank": F.row_number().over(Window.partitionBy(*group).orderBy(*order)), "_all": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    return ranked.where((F.col("_rank") <= n) & (F.col("_all") >= n)).drop("_rank", "_all")


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by the order; map-side combine keeps a hot key's rows apart until they are one each."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*key, "_first.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def dictionary_encode(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, code: codes 0, 1, ... by first appearance in a unique integer order, numbered in blocks so that any number of distinct values will do."""
    seen = df.groupBy(value).agg(F.min(order).alias("_first"))
    return dense_number(seen, "_first", "code").select(value, "code")


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Fold an event log to the last event of each key."""
    rest = [c for c in events.columns if c != key and c not in order]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(key, "_last.*")


def next_sequence(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One more than the largest number in names that match; 1 without any."""
    number = F.expr(f"try_cast(regexp_extract(`{column}`, '{pattern}', 1) AS BIGINT)")
    return df.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_sequence"))


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old, new of settings (path, value) that differ or are on one side only."""
    a, b = old.select("path", F.col("value").alias("old")), new.select("path", F.col("value").alias("new"))
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def totals(episodes: DataFrame, chunk_size: int, video_keys: int) -> DataFrame:
    n = F.count(F.lit(1))
    return episodes.agg(n.alias("total_episodes"), F.sum("length").cast("long").alias("total_frames"), F.when(n > 0, F.floor((n - 1) / chunk_size) + 1).otherwise(0).cast("long").alias("total_chunks"), (n * video_keys).alias("total_videos"))
