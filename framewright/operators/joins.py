"""Range, interval and as-of joins as equi-joins plus filters, so that they hash-partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Points with the half-open ranges [start, end) that hold them. Ranges are cut into cells of ``width``; a point has one cell, so the join is an equi-join.

    ``how`` is inner or left_semi. Ranges may overlap; ``width`` near the usual length of a range keeps cells few.
    """
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    right = ranges.where(F.col(start) < F.col(end)).withColumn("_cell", cells)
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(start).alias("_start"), F.col(end).alias("_end"), "_cell", *[c for c in ranges.columns if c not in (*keys, start, end) and how == "inner"])
    left = points.withColumn("_at", F.floor(F.col(point) / width))
    match = (F.col("_at") == F.col("_cell")) & (F.col(point) >= F.col("_start")) & (F.col(point) < F.col("_end"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_r_{k}"))
    out = left.join(right, match, how).drop("_at")
    if how == "inner":
        out = out.drop("_cell", *[f"_r_{k}" for k in keys]).withColumnsRenamed({"_start": start, "_end": end})
    return out


def clip_intervals(segments: DataFrame, window_start: Column, window_end: Column) -> DataFrame:
    """Segments [start_frame, end_frame) cut to a window; empty ones go."""
    cut = segments.withColumn("_s", F.greatest("start_frame", window_start)).withColumn("_e", F.least("end_frame", window_end)).where("_s < _e")
    return cut.drop("start_frame", "end_frame").withColumnsRenamed({"_s": "start_frame", "_e": "end_frame"})


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, max_age: float | None = None) -> DataFrame:
    """The latest right value at or before each left row's time, null if older than max_age. One sort of the union by key; no pairs are made."""
    tagged = left.withColumns({"_side": F.lit(1), "_seen": F.lit(None).cast("struct<t:double,v:double>")}).unionByName(
        right.select(*keys, time, F.lit(0).alias("_side"), F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_seen")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = tagged.withColumn("_last", F.last("_seen", ignorenulls=True).over(w)).where("_side = 1")
    age = F.col(time).cast("double") - F.col("_last.t")
    fresh = F.lit(True) if max_age is None else age <= max_age + 1e-12
    return found.withColumns({value: F.when(fresh, F.col("_last.v")), "age": F.when(fresh, age)}).drop("_side", "_seen", "_last")


def compare_scans(first: DataFrame, second: DataFrame, key: str, state: str) -> DataFrame:
    """Two snapshots: stable where both agree, else busy, new or gone."""
    a, b = first.select(key, F.col(state).alias("_a")), second.select(key, F.col(state).alias("_b"))
    verdict = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "stable").otherwise("busy")
    return a.join(b, key, "full_outer").select(key, verdict.alias("verdict"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side: missing (left only) or extra (right only)."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.where("_l IS NULL OR _r IS NULL").select(*keys, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("side"))
