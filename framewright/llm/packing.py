"""Operator 9: conflict-constrained best-fit packing.

Texts become sequences of at most ``capacity`` tokens. A text longer than that fills whole bins of its own and its rest is packed. A bin carries bitmaps of the sources (two planes,
so at most two rows of one source meet in a bin) and of the duplicate clusters in it (a cluster never meets itself). Bins are ordered by what they have left; the search starts at the
tightest bin that is large enough and goes on to the next larger until one is compatible; if none is, a bin is opened.

Rows are dealt by their places in a stored table to shards of about ``rows_per_shard`` rows, as many as the input needs, and each shard packs its own bins: a hot source, a group of copies or equal rows spread over all
shards, and only ids and numbers move, never texts. Bitmaps hold 64 sources and 256 clusters by hash; two that share a bit are kept apart, which is never wrong.

Tokens are operator 2's ids of the whole text and one end token, and the clusters are operator 7's classes of near copies, unless columns n_tokens and cluster are given; the ids of a piece are those of the
document's record in operator 2's store from ``start`` on. A null or empty text has the end token only. Null sources share one source; null
clusters conflict with nothing. Equal lengths go by doc_id, nulls first. Of bins with equally much left, the one last filled is the tightest. Repeated rows are packed as often as they occur; an empty table gives no bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import near_dedup, token_store
from framewright.llm.common import documents, materialize

CAPACITY = 2048
ROWS_PER_SHARD = 4096
CLUSTER_WORDS = 4
SCHEMA = "doc_id long, bin_id string, start long, length long, position long, bin_used long"


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Items are placed longest first, equal ones in the order given. sources: bit numbers;
    clusters: bit numbers below 64 * CLUSTER_WORDS, or -1. Lengths are at most ``capacity``."""
    n = len(lengths)
    left = np.zeros(n + 1, np.int64)  # ascending, over the bins in use
    number = np.zeros(n + 1, np.int64)
    once, twice = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    members = np.zeros((n + 1, CLUSTER_WORDS), np.uint64)
    used, out = 0, np.zeros(n, np.int64)
    one = np.uint64(1)
    for item in np.argsort(-lengths, kind="stable"):
        size, source, cluster = int(lengths[item]), one << np.uint64(sources[item]), int(clusters[item])
        word, bit = cluster >> 6, one << np.uint64(cluster & 63)
        at, found, step = int(np.searchsorted(left[:used], size)), -1, 16
        while at < used:
            some = slice(at, min(used, at + step))
            free = (twice[some] & source) == 0
            if cluster >= 0:
                free &= (members[some, word] & bit) == 0
            if free.any():
                found = at + int(free.argmax())
                break
            at, step = some.stop, step * 4
        if found < 0:
            row = (used, capacity, np.uint64(0), np.uint64(0), np.zeros(CLUSTER_WORDS, np.uint64))
            old, used = used, used + 1
        else:
            row = (int(number[found]), int(left[found]), once[found], twice[found], members[found].copy())
            old = found
        home, rest, first, second, marks = row
        rest -= size
        if cluster >= 0:
            marks[word] |= bit
        to = int(np.searchsorted(left[:old], rest))
        for column in (left, number, once, twice, members):
            column[to + 1 : old + 1] = column[to:old].copy()
        left[to], number[to], once[to], twice[to], members[to] = rest, home, first | source, second | (first & source), marks
        out[item] = home
    return out


def pack(df: DataFrame, capacity: int = CAPACITY, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """df, a stored table, has doc_id and n_tokens, source and cluster if known. One row for each piece: bin_id, first token and length in the document, position in the bin, tokens in the bin."""
    shards = max(1, math.ceil(df.count() / rows_per_shard))

    def column(name, kind, default):
        return (F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)).alias(name)

    items = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(1)), F.lit(1)).alias("n_tokens"), column("source", "string", None), column("cluster", "long", None), F.monotonically_increasing_id().alias("place"))
    bit = F.coalesce(F.pmod(F.xxhash64("cluster"), F.lit(64 * CLUSTER_WORDS)), F.lit(0)).cast("int")
    items = items.select("doc_id", "n_tokens", F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(64)).cast("int").alias("source"), bit.alias("bit"), F.col("cluster").isNotNull().alias("marked"), F.pmod(F.xxhash64("place", F.lit(17)), F.lit(shards)).alias("shard"))

    def run(key, pdf):
        shard = int(key[0])
        pdf = pdf.sort_values(["doc_id", "n_tokens", "source", "bit"], kind="stable", na_position="first").reset_index(drop=True)
        total = pdf["n_tokens"].to_numpy(np.int64)
        full, rest = total // capacity, total % capacity
        item = np.flatnonzero(rest)
        homes = best_fit(rest[item], pdf["source"].to_numpy()[item], np.where(pdf["marked"], pdf["bit"], -1)[item], capacity)
        packed = pd.DataFrame({"row": item, "bin_id": [f"{shard}-{h}" for h in homes], "start": full[item] * capacity, "length": rest[item]})
        rows = np.repeat(np.arange(len(full)), full)
        part = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        whole = pd.DataFrame({"row": rows, "bin_id": [f"{shard}-full-{i}" for i in range(len(rows))], "start": part * capacity, "length": capacity})
        out = pd.concat([whole, packed], ignore_index=True)
        out["position"] = out.groupby("bin_id")["length"].cumsum() - out["length"]
        out["bin_used"] = out.groupby("bin_id")["length"].transform("sum")
        out["doc_id"] = pdf["doc_id"].astype("Int64").to_numpy()[out["row"]]
        return out[["doc_id", "bin_id", "start", "length", "position", "bin_used"]]

    return items.groupBy("shard").applyInPandas(run, SCHEMA)


def _token_counter():
    """A function from an Arrow array of texts to their numbers of operator 2's ids with the end token, and their words. The first texts of a task are held against the library."""
    counter, checked = token_store.word_counter(token_store.default_tokenizer_path()), False

    def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal checked
        if not checked:
            counter.check([t[: token_store.CHECKED_CHARACTERS] if t else t for t in texts.slice(0, token_store.CHECKED_TEXTS).to_pylist()])
            checked = True
        sizes, words, ends = counter.count(texts)
        return sizes + 1, words, ends

    return counted


def with_lengths(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, source and a cluster of exact copies (none for null texts) of each document. n_tokens: operator 2's ids of the whole text and one end token."""
    path = token_store.default_tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, ends in token_store.encoded(batches, 1, path):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends) + 1), batch.column(2), batch.column(3)], names=["doc_id", "n_tokens", "source", "cluster"])

    cluster = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    items = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"))
    return items.mapInArrow(count, "doc_id long, n_tokens long, source string, cluster long")


def with_classes(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, source and operator 7's class of near copies of each document, null texts included as empty ones. Tokens are counted where operator 7 reads the texts."""
    classes = near_dedup.classified(df.select("doc_id", "text", F.col("source").cast("string").alias("source")), ("n_tokens", _token_counter))
    return classes.select("doc_id", "n_tokens", F.col("others.source").alias("source"), F.col("class_row").alias("cluster"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(with_classes(documents(spark, sf_dir)), "items"))
