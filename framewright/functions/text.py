"""Prompts, paths, identifiers, canonical JSON and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(x) -> Column:
    """All white space at both ends, line ends too."""
    return F.regexp_replace(_col(x), r"^\s+|\s+$", "")


def clean_prompt(x, lower: bool = True) -> Column:
    out = F.translate(strip(x), "_\n", "  ")
    return F.lower(out) if lower else out


def format_prompt(task, bins) -> Column:
    return F.concat(F.lit("Task: "), clean_prompt(task), F.lit(", State: "), F.array_join(F.transform(_col(bins), lambda b: b.cast("string")), " "), F.lit(";\nAction: "))


def action_part(x) -> Column:
    """Between 'Action: ' and the first bar; empty if there is no such mark."""
    return F.when(F.instr(_col(x), "Action: ") > 0, strip(F.substring_index(F.element_at(F.split(_col(x), "Action: ", 2), -1), "|", 1))).otherwise(F.lit(""))


def pad_tokens(tokens, width: int, fill: int = 0) -> Column:
    t = F.slice(_col(tokens), 1, width)
    return F.concat(t, F.array_repeat(F.lit(fill), F.greatest(F.lit(width) - F.size(t), F.lit(0))))


def token_mask(tokens, width: int) -> Column:
    n = F.least(F.size(_col(tokens)), F.lit(width))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < n)


def chunk_of(episode, size: int = 1000) -> Column:
    return F.floor(_col(episode) / size).cast("long")


def episode_path(episode, size: int = 1000) -> Column:
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk_of(episode, size), _col(episode))


def episode_of_path(path) -> Column:
    return F.expr(f"try_cast(regexp_extract({_name(path)}, 'episode_([0-9]+)[.]parquet$', 1) AS BIGINT)")


def _name(c) -> str:
    if not isinstance(c, str):
        raise TypeError("a column name is needed")
    return f"`{c}`"


def step_id(*parts) -> Column:
    return F.concat_ws("--", *[_col(p).cast("string") for p in parts])


def is_sha256(x) -> Column:
    return F.coalesce(_col(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def canonical_json(*columns: str) -> Column:
    """Compact JSON with keys in ascending order; null fields are written as null."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def seed_of(key) -> Column:
    """A 32-bit seed from the sha256 of a key."""
    return F.conv(F.substring(F.sha2(_col(key).cast("string"), 256), 1, 8), 16, 10).cast("long")


def seconds_and_nanos(ns) -> Column:
    return F.struct(F.floor(_col(ns) / 1_000_000_000).cast("long").alias("sec"), F.pmod(_col(ns), F.lit(1_000_000_000)).cast("long").alias("nanosec"))


def lease_end(start, seconds: int = 300) -> Column:
    return F.date_format(_col(start) + F.expr(f"INTERVAL {seconds} SECONDS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def batch_id(ns) -> Column:
    return F.concat(F.lit("batch_"), F.date_format(F.timestamp_micros((_col(ns) / 1000).cast("long")), "yyyyMMdd_HHmmss"))


def required_space(size) -> Column:
    """Bytes plus a reserve of a fifth, 10 GiB at least."""
    return _col(size) + F.greatest(F.lit(10 * 1024**3).cast("long"), F.ceil(_col(size) / 5))


def output_count(horizon, command_hz: float, model_hz: float) -> Column:
    return F.greatest(F.lit(2), F.bround(_col(horizon) * command_hz / model_hz)).cast("long")


def update_budget(chunks, ratio: int, delay: int) -> Column:
    steps = _col(chunks) * ratio
    return F.struct(steps.cast("long").alias("critic"), F.floor(steps / delay).cast("long").alias("actor"))


def schedule(step, warmup: int, peak: float, total: int, end: float) -> Column:
    """Linear warm-up, then a half cosine from peak to end."""
    s = _col(step).cast("double")
    progress = F.least(F.greatest((s - warmup) / float(max(1, total - warmup)), F.lit(0.0)), F.lit(1.0))
    return F.when(s < warmup, peak * (s + 1) / float(warmup + 1)).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(progress * 3.141592653589793)))
