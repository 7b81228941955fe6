"""Feature statistics by dimension, correlations at lags and small summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.1, 0.5, 0.9, 0.99)
#: So many values are sorted by one task at most when exact quantiles are looked for, and so many cut points narrow larger spans.
SMALL, CUTS = 1_000_000, 500


def by_dimension(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """keys, dim, x: one row an element; NaN becomes null so that it doesn't poison sums."""
    exploded = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    return exploded.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def _stats():
    return [F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count")]


def _span_counts(rows: DataFrame, spans: list[tuple]) -> dict[tuple, tuple]:
    """(dim, lo, hi) -> values below lo, equal to lo, between, equal to hi."""
    x, table = F.col("x"), rows.sparkSession.createDataFrame(sorted(spans), "dim int, lo double, hi double")
    flags = {"below": x < F.col("lo"), "at_lo": x == F.col("lo"), "between": (x > F.col("lo")) & (x < F.col("hi")), "at_hi": x == F.col("hi")}
    found = rows.join(F.broadcast(table), "dim").groupBy("dim", "lo", "hi").agg(*[F.sum(c.cast("long")).alias(n) for n, c in flags.items()])
    return {(r.dim, r.lo, r.hi): (r.below, r.at_lo, r.between, r.at_hi) for r in found.collect()}


def exact_quantiles(rows: DataFrame, levels: list[float], names: list[str], most: int = SMALL) -> DataFrame:
    """dim and the interpolated quantiles of x of each dimension (dim, x). Nulls don't count; infinite values do, at the ends.

    Each wanted rank has an open span of values that holds it. While a span has more than ``most`` values, cut points by rank (approximate, with a stated error) narrow it, and exact counts say what is below and whether the
    rank falls on one of its ends, so neither outliers nor repeated values leave a large span. Then the values of a span, equal ones as one row, are sorted by one task, ``most`` at most. The driver holds the ends of dims times ranks spans.
    """
    rows = rows.where("x IS NOT NULL").select(F.col("dim").cast("int").alias("dim"), F.col("x").cast("double").alias("x"))
    spark, inf = rows.sparkSession, float("inf")
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = {(dim, level): (n - 1) * level for dim, n in sizes.items() for level in levels}
    spans = {(dim, int(f(a))): (-inf, inf) for (dim, _), a in at.items() for f in (math.floor, math.ceil)}
    values, inside = {}, {}  # found: (dim, rank) -> value; looked into: (dim, rank) -> values below and between
    while spans:
        counts = _span_counts(rows, {(dim, *ends) for (dim, _), ends in spans.items()})
        large = {}
        for (dim, rank), (lo, hi) in spans.items():
            below, at_lo, between, at_hi = counts[dim, lo, hi]
            if below <= rank < below + at_lo:
                values[dim, rank] = lo
            elif below + at_lo + between <= rank < below + at_lo + between + at_hi:
                values[dim, rank] = hi
            elif between <= most:
                inside[dim, rank] = (lo, hi, below + at_lo)
            else:
                large[dim, rank] = (lo, hi, (rank - below - at_lo) / between)
        if not large:
            break
        table = spark.createDataFrame(sorted({(dim, lo, hi) for (dim, _), (lo, hi, _) in large.items()}), "dim int, lo double, hi double")
        grid = [i / CUTS for i in range(CUTS + 1)]
        cuts = {(r.dim, r.lo, r.hi): r.cuts for r in rows.join(F.broadcast(table), "dim").where("x > lo AND x < hi").groupBy("dim", "lo", "hi").agg(F.percentile_approx("x", grid, 20 * CUTS).alias("cuts")).collect()}
        spans = {}
        for (dim, rank), (lo, hi, share) in large.items():
            i, points = int(share * CUTS), cuts[dim, lo, hi]
            spans[dim, rank] = (points[i - 1] if i > 0 else lo, points[i + 2] if i + 2 <= CUTS else hi)
    if inside:
        wanted = sorted({(dim, *span) for (dim, _), span in inside.items()})
        table = spark.createDataFrame(wanted, "dim int, lo double, hi double, before long")
        ranks = spark.createDataFrame(sorted((dim, *span, rank) for (dim, rank), span in inside.items()), "dim int, lo double, hi double, before long, rank long")
        keys = ["dim", "lo", "hi", "before"]
        sorted_ = rows.join(F.broadcast(table), "dim").where("x > lo AND x < hi").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
        sorted_ = sorted_.withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
        found = sorted_.join(F.broadcast(ranks), keys).where("rank < end AND rank >= end - c").select("dim", "rank", "x").collect()
        values |= {(r.dim, r["rank"]): r.x for r in found}

    def between(dim: int, level: float) -> float:
        a = at[dim, level]
        lo, hi = values[dim, math.floor(a)], values[dim, math.ceil(a)]
        return lo if lo == hi else lo + (hi - lo) * (a - math.floor(a))

    return spark.createDataFrame([(dim, *(between(dim, level) for level in levels)) for dim in sorted(sizes)], "dim int, " + ", ".join(f"`{n}` double" for n in names))


def feature_statistics(df: DataFrame, vector: str, quantiles: bool = True) -> DataFrame:
    rows = by_dimension(df, vector, [])
    out = rows.groupBy("dim").agg(*_stats())
    return out.join(F.broadcast(exact_quantiles(rows, list(QUANTILES), [f"q{int(v * 100):02d}" for v in QUANTILES])), "dim", "left") if quantiles else out


def episode_and_global_statistics(df: DataFrame, vector: str, episode: str = "episode_index") -> DataFrame:
    """The same figures for each episode and for all (episode null), in one aggregation by grouping sets."""
    rows = by_dimension(df, vector, [episode])
    return rows.groupingSets([[F.col(episode), F.col("dim")], [F.col("dim")]], F.col(episode), F.col("dim")).agg(*_stats())


def running_norm(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population std of each dimension (variance not below 0); a dimension needs two rows."""
    return by_dimension(df, vector, []).groupBy("dim").agg(F.avg("x").alias("mean"), F.sqrt(F.greatest(F.var_pop("x"), F.lit(0.0))).alias("std"), F.count("x").alias("n")).where("n >= 2")


def histogram_quantiles(df: DataFrame, vector: str, bins: int, levels: tuple[float, ...] = (0.01, 0.99)) -> DataFrame:
    """Left edge of the first of ``bins`` equal bins at which the running count reaches level * n. Bins of a dimension are few, whatever the rows."""
    rows = by_dimension(df, vector, []).where("x IS NOT NULL")
    bounds = rows.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    step = (F.col("high") - F.col("low")) / bins
    placed = rows.join(F.broadcast(bounds), "dim").withColumn("bin", F.when(step <= 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("low")) / F.greatest(step, F.lit(1e-300))), F.lit(bins - 1))).cast("int"))
    counts = placed.groupBy("dim", "bin", "low", "high", "n").agg(F.count(F.lit(1)).alias("c"))
    reached = counts.withColumn("sofar", F.sum("c").over(Window.partitionBy("dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    edge = F.col("low") + F.col("bin") * step
    return reached.groupBy("dim").agg(*[F.min(F.when(F.col("sofar") >= level * F.col("n"), edge)).alias(f"q{int(level * 100):02d}") for level in levels])


def lagged_correlations(df: DataFrame, a: str, b: str, lags: range, order: list[str], least_std: float, keys: list[str]) -> DataFrame:
    """keys, lag, corr: Pearson correlation of a[t] and b[t + lag]; null for fewer than 3 pairs or too little spread."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(a).alias("x"), (F.lead(b, k) if k >= 0 else F.lag(b, -k)).over(w).alias("y")) for k in lags])
    rows = df.select(*keys, pairs.alias("_pairs")).select(*keys, F.explode("_pairs").alias("p")).select(*keys, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    groups = rows.groupBy(*keys, "lag").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    good = (F.col("n") >= 3) & (F.col("sx") >= least_std) & (F.col("sy") >= least_std)
    return groups.select(*keys, "lag", F.when(good, F.try_divide("c", F.col("sx") * F.col("sy"))).alias("corr"))


def best_lag(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The lag with the largest absolute correlation; equal ones go to the smallest lag."""
    best = F.max_by(F.struct("lag", "corr"), F.struct(F.abs("corr"), -F.col("lag")))
    return correlations.where("corr IS NOT NULL").groupBy(*keys).agg(best.alias("b")).select(*keys, "b.lag", "b.corr")


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / (F.sum(weight) + 1e-8)).alias("weighted_mean"))


def sampled_channels(images: DataFrame, video: str, pixels: str, channels: int, most: int = 100) -> DataFrame:
    """video, channel, min, max, mean, std over all pixels of at most ``most`` evenly spaced frames, and count, the number of those frames. images: video, frame_index (0, 1, ...), pixels (interleaved by channel)."""
    sizes = images.groupBy(video).agg(F.count(F.lit(1)).alias("n"))
    take = F.least(F.col("n"), F.lit(most))
    at = F.transform(F.sequence(F.lit(0).cast("long"), take - 1), lambda k: F.floor(k * (F.col("n") - 1) / F.greatest(take - 1, F.lit(1))))
    chosen = sizes.select(video, F.explode(F.array_distinct(at)).alias("frame_index"))
    rows = images.join(chosen, [video, "frame_index"]).select(video, "frame_index", F.posexplode(F.col(pixels).cast("array<double>")).alias("_at", "x"))
    return rows.groupBy(video, (F.col("_at") % channels).cast("long").alias("channel")).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.countDistinct("frame_index").alias("count"))
