"""Sampling, batching and mixing. Draws are hashes of keys, so a task that runs again, or another partitioning, draws the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.windows import EPISODE


BITS = 60


def draw(seed: int, *keys: str | Column) -> Column:
    """A number in 0..2**60 - 1 by the md5 of the seed and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def share(seed: int, *keys: str | Column) -> Column:
    """A number in 0..1, below 1 but for rounding."""
    return draw(seed, *keys) / F.lit(float(1 << BITS))


def with_replacement(df: DataFrame, index: str, n: int, seed: int) -> DataFrame:
    """n rows drawn with replacement by a gap-free index 0..N-1, with their place in the request; none of an empty table."""
    size = df.count()
    drawn = df.sparkSession.range(n if size else 0).select(F.col("id").alias("place")).withColumn(index, draw(seed, "place") % F.lit(max(1, size)))
    return drawn.join(df, index)


def gather(requests: DataFrame, frames: DataFrame, vector: str, step: int = 1) -> DataFrame:
    """place, vector, next (``step`` frames on; zeros past the end) and is_terminal of each request (place, episode_index, frame_index), one row a request whatever repeats; frames are dense.

    Requests go to their two frames; no frame is moved that none asks for.
    """
    asked = requests.select("place", *EPISODE, F.col("frame_index").alias("_from"), F.explode(F.array(F.lit(0), F.lit(step))).alias("_ahead"))
    met = asked.withColumn("frame_index", F.col("_from") + F.col("_ahead")).join(frames.select(*EPISODE, "frame_index", F.struct(F.col(vector).alias("v")).alias("_row")), [*EPISODE, "frame_index"])
    found = met.groupBy("place", *EPISODE, "_from").agg(F.first(F.when(F.col("_ahead") == 0, F.col("_row")), ignorenulls=True).alias("_now"), F.first(F.when(F.col("_ahead") == step, F.col("_row")), ignorenulls=True).alias("_then"))
    now, then = F.col("_now.v"), F.col("_then.v")
    return found.where(F.col("_now").isNotNull()).select("place", now.alias(vector), F.coalesce(then, F.transform(now, lambda x: x * 0)).alias("next"), then.isNull().alias("is_terminal"))


def weighted_mix(parts: list[DataFrame], weights: list[float], key: str, seed: int) -> DataFrame:
    """A union in which the parts have about the given shares; the scarcest part (against its weight) is taken whole. A row is taken by a hash of its key."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    sizes = [p.count() for p in parts]
    total = min((s / w for s, w in zip(sizes, weights) if w > 0), default=0)
    return reduce(DataFrame.unionByName, [p.where(share(seed, key) < F.lit(min(1.0, total * w / s) if s else 0.0)) for p, s, w in zip(parts, sizes, weights)])


def batches(df: DataFrame, index: str, size: int) -> DataFrame:
    """batch, items: full batches in the order of a gap-free index; a last partial one is dropped."""
    grouped = df.groupBy(F.floor(F.col(index) / size).alias("batch")).agg(F.array_sort(F.collect_list(index)).alias("items"))
    return grouped.where(F.size("items") == size)


def shuffled_subset(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """At most n rows, those with the smallest hashes of a unique key (a cap is what this operator is for). Hashes are counted in cells; cells below the n-th row's are taken whole, only that one is sorted."""
    cell = F.shiftright(draw(seed, key), BITS - 20)
    marked = df.withColumn("_cell", cell)
    so_far = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # a row a cell, a million at most
    counts = marked.groupBy("_cell").agg(F.count(F.lit(1)).alias("c")).withColumn("end", F.sum("c").over(so_far))
    border = counts.where(F.col("end") > n).orderBy("_cell").first()
    if border is None:
        return df
    last = marked.where(F.col("_cell") == border._cell).orderBy(draw(seed, key), key).limit(n - (border.end - border.c))
    return marked.where(F.col("_cell") < border._cell).unionByName(last).drop("_cell")


def shuffle_buffer(df: DataFrame, index: str, slots: int, seed: int, epochs: int = 1) -> DataFrame:
    """position, epoch, index: the order in which a buffer of ``slots`` rows gives out a table read ``epochs`` times over by a gap-free index.

    The first rows fill the slots. Each later one draws a slot, gives out what is in it and takes its place; at the end the slots are given out in order. So a row leaves when its slot is drawn next, which a window over each
    slot's own steps tells: no global sort, and no task holds more than a slot's steps.
    """
    n = df.count()
    total = n * epochs
    filled = min(slots, total)
    if not total or slots < 1:
        return df.select(F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("epoch"), F.col(index)).limit(0)
    steps = df.select(index, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))).alias("epoch")).withColumn("_step", F.col("epoch") * n + F.col(index))
    slot = F.when(F.col("_step") < filled, F.col("_step")).otherwise(draw(seed, "_step") % filled)
    leaves = F.lead("_step").over(Window.partitionBy("_slot").orderBy("_step"))
    return steps.withColumn("_slot", slot).select(F.coalesce(leaves - filled, F.lit(total - filled) + F.col("_slot")).cast("long").alias("position"), "epoch", index)


def choice(fields: list[str], key: str, seed: int) -> Column:
    """One of the fields, drawn for each key."""
    return F.element_at(F.array(*fields), (draw(seed, key) % len(fields) + 1).cast("int"))


def chunk_dropout(chunk: str | Column, key: str, rate: float, seed: int) -> tuple[Column, Column]:
    """The chunk with all values 0 for about ``rate`` of the keys, and whether it was dropped. A chunk is dropped whole."""
    if not 0 <= rate <= 1:
        raise ValueError("a rate outside 0..1")
    dropped = share(seed, key) < rate
    return F.when(dropped, F.transform(chunk, lambda x: x * 0)).otherwise(chunk if isinstance(chunk, Column) else F.col(chunk)), dropped
