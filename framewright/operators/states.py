"""Statistics as mergeable states: counts, moments and quantile points of parts of episodes, stored once and merged later, so that an append adds its own and reads nothing old.

A state holds n, mean, m2 (the sum of squared differences), min and max, and at most ``SIZE`` points: its n sorted values are cut into that many blocks of equal size, up to one, and each block is told by its middle value and its size.
How many values are at most t is thus known up to half a block, ``error``: only one block can lie on both sides of t. Merged states put their points together, each as often as its size says, and cut them anew: errors add up,
and half a new block comes on top. With n <= SIZE every value is a point and the error is 0.

Parts have ``PART`` frames at most, so an episode of any length is bounded groups; states merge in groups of about ``FAN``, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, PART, FAN = 1024, 65_536, 256
ID = ("episode_index", "part")
STATE = "n long, mean double, m2 double, min double, max double, points array<double>, sizes array<long>, error long"
SCHEMA = f"episode_index long, part long, feature string, dim int, {STATE}"


def elements(frames: DataFrame, features: list[str] | None = None) -> DataFrame:
    """episode_index, part, feature, dim, x: one row an element of vector and number features; NaN and null elements are left out."""
    kinds = {f.name: f.dataType for f in frames.schema.fields}
    vectors = [n for n, t in kinds.items() if isinstance(t, T.ArrayType) and (features is None or n in features)]
    numbers = [n for n, t in kinds.items() if isinstance(t, (T.FloatType, T.DoubleType)) and (features is None or n in features)]
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in [*vectors, *numbers]]), F.array(*[F.col(v).cast("array<double>") for v in vectors], *[F.array(F.col(n).cast("double")) for n in numbers]))
    part = F.floor(F.col("frame_index") / PART).alias("part")
    wide = frames.select(F.col("episode_index").cast("long").alias("episode_index"), part, F.explode(values).alias("feature", "v"))
    return wide.select(*ID, "feature", F.posexplode("v").alias("dim", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))


def _middle(k: Column, n: Column, blocks: Column) -> Column:
    """The rank (from 0) that tells block k of n values."""
    start, end = F.floor(k * n / blocks), F.floor((k + 1) * n / blocks)
    return start + F.floor((end - start - 1) / 2)


def _blocks(n: Column, size: int) -> Column:
    return F.least(n, F.lit(size).cast("long"))


def _half_block(n: Column, size: int) -> Column:
    return F.floor(F.ceil(n / _blocks(n, size)) / 2)


def partial_states(frames: DataFrame, features: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """SCHEMA: a state of each part of each episode, feature and dimension."""
    x, n = F.col("x"), F.col("n")
    groups = elements(frames, features).groupBy(*ID, "feature", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("min"), F.max("x").alias("max"), F.array_sort(F.collect_list(x)).alias("_x"))
    k = F.sequence(F.lit(0).cast("long"), _blocks(n, size) - 1)
    points = F.transform(k, lambda i: F.get("_x", _middle(i, n, _blocks(n, size)).cast("int")))
    sizes = F.transform(k, lambda i: (F.floor((i + 1) * n / _blocks(n, size)) - F.floor(i * n / _blocks(n, size))).cast("long"))
    return groups.select(*ID, "feature", "dim", "n", "mean", "m2", "min", "max", points.alias("points"), sizes.alias("sizes"), _half_block(n, size).cast("long").alias("error"))


def _level(states: DataFrame, by: list[str], size: int) -> DataFrame:
    """One state for each group of ``by``. Each state's moments travel with its first point, so its rows are read once."""

    def joined(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    moments = F.struct("n", "mean", "m2", "min", "max", "error")
    rows = states.select(*by, moments.alias("_m"), F.posexplode(F.arrays_zip("points", "sizes")).alias("_at", "_p")).select(*by, F.when(F.col("_at") == 0, F.col("_m")).alias("_m"), F.col("_p.points").alias("x"), F.col("_p.sizes").alias("w"))
    points = rows.groupBy(*by, "x").agg(F.sum("w").alias("w"), F.collect_list("_m").alias("_m"))
    w = Window.partitionBy(*by)
    ranked = points.withColumns({"_end": F.sum("w").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("w").over(w)})
    n, blocks, start = F.col("_n"), _blocks(F.col("_n"), size), F.col("_end") - F.col("w")
    # the blocks whose middle lies among this value's ranks
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(start * blocks / n) - 1), F.least(blocks - 1, F.floor(F.col("_end") * blocks / n) + 1))
    own = F.filter(near, lambda k: (_middle(k, n, blocks) < F.col("_end")) & (_middle(k, n, blocks) >= start))
    cut = F.transform(own, lambda k: F.struct(k.alias("k"), F.col("x").alias("x"), (F.floor((k + 1) * n / blocks) - F.floor(k * n / blocks)).cast("long").alias("w")))
    ranked = ranked.select(*by, "_m", cut.alias("_p"))
    # sorted, so that the same states give the same bits in any order
    found = ranked.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("_m"))).alias("_m"), F.array_sort(F.flatten(F.collect_list(F.when(F.size("_p") > 0, F.col("_p"))))).alias("_p"))
    one = F.transform("_m", lambda m: F.struct(m["n"].alias("n"), m["mean"].alias("mean"), m["m2"].alias("m2")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    errors = F.aggregate("_m.error", F.lit(0).cast("long"), lambda a, b: a + b)
    found = found.withColumns({"_s": F.aggregate(one, zero, joined), "_error": errors})
    total = F.col("_s.n")
    error = F.least(total, F.col("_error") + F.when(total > size, _half_block(total, size)).otherwise(0)).cast("long")
    return found.select(*by, "_s.*", F.array_min("_m.min").alias("min"), F.array_max("_m.max").alias("max"), F.col("_p.x").alias("points"), F.col("_p.w").alias("sizes"), error.alias("error"))


def merge_states(states: DataFrame, keys: list[str], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """One state for each value of keys (feature and dim for all episodes, with episode_index for each). Parts of any appends may be put together in any order."""
    rows = states.withColumn("_group", F.xxhash64(*[F.col(c) for c in states.columns if c not in ("points", "sizes")]))
    most = states.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        groups = -(-most // fan)
        rows = _level(rows.withColumn("_group", F.pmod("_group", F.lit(groups))), [*keys, "_group"], size)
        most, rows = groups, rows.withColumn("_group", F.xxhash64("_group"))
    return _level(rows, keys, size)


def with_statistics(states: DataFrame, levels: dict[str, float]) -> DataFrame:
    """States with std (of the population) and quantiles by name: the point at which the running sizes reach level * n, at most ``error`` ranks off."""
    out = states.withColumn("std", F.sqrt(F.greatest(F.col("m2") / F.col("n"), F.lit(0.0))))
    ends = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))

    def at(level: float) -> Column:
        rank = F.greatest(F.ceil(F.col("n") * F.lit(level)), F.lit(1))
        return F.get("points", F.size(F.filter("_ends", lambda e: e < rank)))

    return out.withColumn("_ends", ends).withColumns({name: at(level) for name, level in levels.items()}).drop("_ends")


def write_states(frames: DataFrame, path: str) -> None:
    partial_states(frames).write.parquet(path)


def read_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
