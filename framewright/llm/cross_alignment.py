"""Operator 12: alignment of two tokenizers by a label string over bytes.

A blank and the text are cut by both tokenizers. Each byte gets a label: ``.`` (no token ends), ``a`` (one of A ends), ``b`` (one of B ends), ``c`` (both end). A regular expression takes the spans up to each ``c``: the
groups of tokens that cover the same bytes; a span's labels count its tokens. Between two labels lie bytes of one token of A and one of B, and no two labels part the same two tokens, so each label is one link.

A text's distinct linked id pairs are stored once, sorted, as differences. How many texts hold a pair is counted over all texts, with sums of each task's pairs before the shuffle. The most frequent pairs, ``FREQUENT``
at most (12 bytes each), and the highest count of each id of A, which the vocabulary bounds, go to every task; what a text has of other pairs meets its count by a join.

A is a byte-level file of the tokenizers library. If its merges are numbered in order, as its ids are, and nothing else changes the text, ids come from the tiktoken library with the file's own vocabulary as ranks, which is faster
and equal; each task compares the first ``CHECKED_CHARACTERS`` characters of its first ``CHECKED_TEXTS`` texts with the tokenizers library and fails if they differ. B is a model of the sentencepiece library.

Null and empty texts, and texts that the tokens of either side don't give back byte for byte, have no tokens: zeros and an empty digest. Null ids and repeated rows stay as rows of their own, and each row counts.
Texts are encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import discard, documents, materialize, slices

FREQUENT = 4_000_000
CHECKED_TEXTS, CHECKED_CHARACTERS = 10, 20_000
#: Pairs that a task holds before it sends their sums.
HELD_PAIRS = 1 << 23
_SPAN = re.compile(rb"[^c]*c")
#: Spans whose counts a worker remembers, and the longest such span.
REMEMBERED_SPANS, REMEMBERED_LENGTH = 200_000, 64
SIZES = ("n_a", "n_b", "n_groups", "n_links")


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- the two sides ----------------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next one after 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteLevel:
    """Side A."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), said["model"]["vocab"]
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in said["added_tokens"])])
        self.bytes = [b""] * self.size
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece)
        for token in said["added_tokens"]:
            self.bytes[token["id"]] = token["content"].encode()
        splitter, model = said["pre_tokenizer"], said["model"]
        in_order = all(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i for i, m in enumerate(model["merges"]))
        plain = said["normalizer"] is None and splitter["type"] == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"] and not model.get("ignore_merges") and not model.get("dropout")
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={}) if in_order and plain else None

    def _by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def check(self, texts: list[str]) -> None:
        for text, ids in zip(texts, self._by_library(texts)):
            if self.fast and not np.array_equal(self.fast.encode_to_numpy(text, disallowed_special=()), ids):
                raise ValueError(f"the two libraries encode a text differently: {text[:80]!r}")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts] if self.fast else self._by_library(texts)


class Pieces:
    """Side B, which puts the blank in front of a text itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.library.id_to_piece(i)) for i in range(self.size))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.library.encode(texts, num_threads=1)]


class _Counts(dict):
    """A span's tokens of A and of B, in one number."""

    def __missing__(self, span: bytes) -> int:
        found = (span.count(b"a") + 1) << 32 | span.count(b"b") + 1
        if len(span) <= REMEMBERED_LENGTH and len(self) < REMEMBERED_SPANS:
            self[span] = found
        return found


class Pair:
    """Two tokenizers, and what both need to align texts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        # an id and what follows it in a digest: a comma inside a group's side, else the side's end
        self.written = [b"%d%s" % (i, end) for side, last in ((self.a, b"|"), (self.b, b";")) for end in (b",", last) for i in range(side.size)]
        self.counted = _Counts()
        self.dtype = np.dtype("<u4") if self.a.size * self.b.size <= 1 << 32 else np.dtype("<u8")

    def align(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, texts)


class Aligned:
    """Tokens, groups and links of texts that both sides give back; the bytes of all of them stand in one row."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        self.pair = pair
        known = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in known]
        raw, a, b = [t.encode() for t in spaced], pair.a.encode(spaced), pair.b.encode([texts[i] for i in known])
        whole = [k for k, r in enumerate(raw) if b"".join(map(pair.a.bytes.__getitem__, a[k].tolist())) == r == b"".join(map(pair.b.bytes.__getitem__, b[k].tolist()))]
        self.texts = np.array([known[k] for k in whole], np.int64)  # of the list given
        self.ids = [np.concatenate([np.zeros(0, np.uint32), *(side[k] for k in whole)]).astype(np.int64) for side in (a, b)]
        self.tokens = [np.array([len(side[k]) for k in whole], np.int64) for side in (a, b)]
        self.ends = np.cumsum([len(raw[k]) for k in whole]).astype(np.int64)
        mark = np.zeros(int(self.ends[-1]) if whole else 0, np.uint8)
        for bit, ids, size in zip((1, 2), self.ids, pair.sizes):
            mark[np.cumsum(size[ids]) - 1] |= bit
        labels = np.frombuffer(b".abc", np.uint8)[mark].tobytes()
        spans = _SPAN.findall(labels)
        counts = np.fromiter(map(pair.counted.__getitem__, spans), np.int64, len(spans))
        self.group_tokens = [counts >> 32, counts & 0xFFFFFFFF]
        self.group_ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        self.groups = self._per_text(self.group_ends - 1)
        # every label is a link
        at = np.flatnonzero(mark)
        ends_a, ends_b = (mark[at] & 1).astype(np.int64), (mark[at] >> 1).astype(np.int64)
        self.links = self._per_text(at)
        self.link = self.ids[0][np.cumsum(ends_a) - ends_a] * pair.b.size + self.ids[1][np.cumsum(ends_b) - ends_b]

    def _per_text(self, at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, self.ends), prepend=0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct linked pairs (id of A times the size of B, plus id of B) in order, their links, and how many pairs each text has."""
        base = self.pair.a.size * self.pair.b.size
        key, times = np.unique(np.repeat(np.arange(len(self.texts)), self.links) * base + self.link, return_counts=True)
        text, key = np.divmod(key, base)
        return key, times, np.bincount(text, minlength=len(self.texts))

    def digests(self) -> list[str]:
        n_a, n_b = self.group_tokens
        size = n_a + n_b
        start = np.cumsum(size) - size
        code = np.empty(int(size.sum()), np.int64)
        base = 0
        for ids, n, skip, side in ((self.ids[0], n_a, 0, self.pair.a), (self.ids[1], n_b, n_a, self.pair.b)):
            last = np.zeros(len(ids), np.int64)
            last[np.cumsum(n) - 1] = side.size
            place = np.repeat(start + skip - (np.cumsum(n) - n), n) + np.arange(len(ids))
            code[place] = base + ids + last
            base += 2 * side.size
        written = list(map(self.pair.written.__getitem__, code.tolist()))
        ends = np.cumsum(self.tokens[0] + self.tokens[1]).tolist()
        return [hashlib.sha256(b"".join(written[s:e])[:-1]).hexdigest() for s, e in zip([0, *ends], ends)]


_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    pair, checked = tokenizer_pair(*paths), False
    for whole in batches:
        for batch in slices(whole, 1, size=2 << 20):
            texts = batch.column(1).to_pylist()
            if not checked:
                pair.a.check([" " + t[:CHECKED_CHARACTERS] for t in texts[:CHECKED_TEXTS] if t])
                checked = True
            yield batch, pair.align(texts)


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_groups(df: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, row, start, end (bytes of the blank and the text), a, b (ids): every group of every row that has tokens."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _aligned(batches, paths):
            of = np.repeat(np.arange(len(found.texts)), found.groups)
            text_start = (found.ends - np.diff(found.ends, prepend=0))[of]
            start = np.concatenate([[0], found.group_ends[:-1]])[: len(of)]
            sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32))) for n, ids in zip(found.group_tokens, found.ids)]
            row = pa.array(found.texts[of])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(start - text_start), pa.array(found.group_ends - text_start), *sides], names=["doc_id", "row", "start", "end", "a", "b"])

    return _rows(df).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, row long, start long, end long, a array<int>, b array<int>")


# ---- pairs over the corpus ----------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes of numbers, the lowest bytes first: runs of zeros that compress well."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _numbers(planes: bytes, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _keys(planes: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of texts, and how many each has."""
    counts = np.array([len(p) // dtype.itemsize for p in planes], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_numbers(p, dtype), dtype=np.int64) for p in planes if p)]), counts


def aligned_rows(df: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """doc_id, SIZES, groups_sha256, pairs, times (distinct pairs and their links, packed) of every row."""
    names = ["doc_id", *SIZES, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _aligned(batches, paths):
            dtype = found.pair.dtype
            sizes = np.zeros((len(SIZES), batch.num_rows), np.int64)
            sizes[:, found.texts] = [*found.tokens, found.groups, found.links]
            digest, pairs, times = ([empty] * batch.num_rows for empty in ("", b"", b""))
            key, links, held = found.pairs()
            at = np.cumsum(held).tolist()
            for i, s, e, text_digest in zip(found.texts.tolist(), [0, *at], at, found.digests()):
                digest[i], pairs[i], times[i] = text_digest, _planes(np.diff(key[s:e], prepend=0).astype(dtype)), _planes(links[s:e].astype("<u4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sizes), pa.array(digest), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], names=names)

    return _rows(df).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in SIZES) + ", groups_sha256 string, pairs binary, times binary")


def count_pairs(rows: DataFrame, dtype: np.dtype) -> DataFrame:
    """key, n: how many rows hold each linked pair."""

    def sums(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(key), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 200_000]), pa.array(n[at : at + 200_000])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for whole in batches:
            for batch in slices(whole, 0):
                held.append(_keys(batch.column(0).to_pylist(), dtype)[0])
                number += len(held[-1])
                if number > HELD_PAIRS:
                    yield from sums(held)
                    held, number = [], 0
        if number:
            yield from sums(held)

    return rows.select("pairs").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def weigh(rows: DataFrame, counts: DataFrame, pair: Pair) -> DataFrame:
    """doc_id, SIZES, n_best, count_sum, groups_sha256. rows (aligned_rows with a number ``row``) and counts: stored tables."""
    spark, dtype, size_a, size_b = rows.sparkSession, pair.dtype, pair.a.size, pair.b.size
    highest = np.zeros(size_a, np.int64)
    top = counts.groupBy(F.floor(F.col("key") / size_b).alias("a")).agg(F.max("n").alias("n")).toArrow()  # the vocabulary bounds it
    highest[top["a"].to_numpy()] = top["n"].to_numpy()
    # how many pairs have 1, 2 or 3, 4 to 7, ... rows: the least power of two that few enough pairs reach
    by_power = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect())
    power = next(p for p in range(65) if sum(n for q, n in by_power.items() if q >= p) <= FREQUENT)
    frequent = counts.where(F.col("n") >= (1 << power)).toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((frequent["key"].to_numpy(), frequent["n"].to_numpy(), highest))
    kept = ["doc_id", *SIZES, "groups_sha256"]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A line for each row with the sums of its frequent pairs, under a key that no pair has, and one for each other pair of the row."""
        keys, counted, best = shared.value
        for whole in batches:
            for batch in slices(whole, 1):
                key, held = _keys(batch.column(1).to_pylist(), dtype)
                times = np.concatenate([np.zeros(0, np.int64), *(_numbers(t, np.dtype("<u4")) for t in batch.column(2).to_pylist() if t)]).astype(np.int64)
                place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                common = keys[place] == key if len(keys) else np.zeros(len(key), bool)
                n = np.where(common, counted[place], 0) if len(keys) else np.zeros(len(key), np.int64)
                ends = np.cumsum(held)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (times * (common & (n == best[key // size_b])), times * n)]
                row = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(-1 - row), pa.nulls(len(row), pa.int64()), *map(pa.array, sums), *(batch.column(i) for i in range(3, batch.num_columns))], names=names)
                rest = np.flatnonzero(~common)
                if len(rest):
                    none = np.zeros(len(rest), np.int64)
                    blank = [pa.nulls(len(rest), batch.schema.types[i]) for i in range(3, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, held)[rest]), pa.array(key[rest]), pa.array(times[rest]), pa.array(none), pa.array(none), *blank], names=names)

    names = ["row", "key", "times", "n_best", "count_sum", *kept]
    lines = rows.select("row", "pairs", "times", *kept).mapInArrow(known, "row long, key long, times long, n_best long, count_sum long, doc_id long, " + ", ".join(f"{s} long" for s in SIZES) + ", groups_sha256 string")
    heights = spark.createDataFrame([(i, int(n)) for i, n in enumerate(highest.tolist()) if 0 < n < (1 << power)], "a long, highest long")
    rare = counts.where(F.col("n") < (1 << power)).join(F.broadcast(heights), F.floor(F.col("key") / size_b) == F.col("a"), "left").select("key", "n", (F.col("n") == F.col("highest")).alias("is_best"))
    met = lines.join(rare.hint("merge"), "key", "left")
    own = F.coalesce(F.col("times") * F.col("n"), F.lit(0))
    best = F.when(F.col("is_best"), F.col("times")).otherwise(0)
    summed = met.groupBy("row").agg(*[F.max(c).alias(c) for c in kept], F.sum(F.col("n_best") + best).alias("n_best"), F.sum(F.col("count_sum") + own).alias("count_sum"))
    return summed.select("doc_id", *SIZES, "n_best", "count_sum", "groups_sha256")


def align(df: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, SIZES, n_best, count_sum, groups_sha256 of every row of df (doc_id, text)."""
    paths = paths or default_paths()
    pair = tokenizer_pair(*paths)
    rows = materialize(aligned_rows(df, paths).withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    counts = materialize(count_pairs(rows, pair.dtype), "linked-pairs")
    out = materialize(weigh(rows, counts, pair), "aligned")
    discard(rows, counts)
    return out


def op12_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
