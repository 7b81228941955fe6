"""Operator 7: near-duplicate detection by order MinHash, verified by banded alignment.

Words are lower-cased runs between white space (simple case mapping). A text's k-mers are its five-word shingles, each labelled with its occurrence. For each of ``SKETCHES`` hash functions the
``MINIMA`` smallest k-mers are put in text order and hashed to one key; texts that share a key are candidates. A pair is linked if a banded alignment of their
words matches at least 0.8 of the union (matched / (n + m - matched)), so a changed word costs one word and moved text lowers the similarity. Links make classes.

A pair whose five-word shingles are alike at 0.8 is also alike in words, and shares none of 16 keys of 2 minima with probability (1 - 0.8 ** 2) ** 16 < 1e-7. Edits spread over a text break up to five
shingles each; of all pairs of sf0.1 that are alike in words at 0.8, brute force finds none that shares no key (README).

Work follows the number of links, not the square of groups. Exact copies meet in one node first. In every bucket each node is compared with one centre, the node that shares most; sizes and
word counts in ``BINS`` bins rule most pairs out exactly before any text moves. Only buckets that then still hold several classes are looked at again: there every pair of different classes is ruled out by its
words in common or aligned, in the task that has the bucket, and only links leave it, fewer than classes. A large bucket is cut into blocks; each pair of blocks is a group of its own, so no task holds a whole
bucket.

Texts of fewer than five words have one k-mer, all their words. Null and empty texts are copies of one another. Repeated rows are copies; a null doc_id stays null and its class is
the smallest id of its group. An empty table gives an empty result. Texts are compared whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import chain, discard, documents, matched, materialize, mix, ranges, slices, word_hashes

SHINGLE, SKETCHES, MINIMA, SIMILARITY = 5, 16, 2, 0.8
ROWS_PER_BLOCK = 4096
WORDS_PER_BLOCK = 1_000_000
COMPARED = 2048
CELLS = 500_000
#: A count of FULL or more is kept as FULL.
BINS, FULL = 256, 255
_ODD = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# ---- k-mers and keys ---------------------------------------------------------------------------------------------------------------


def elements(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled shingles of many texts, in text order and all distinct in a text. ends: where each text's words begin, and the end; likewise in the result."""
    sizes, total = np.diff(ends), len(words)
    found = np.zeros(total, np.uint64)
    if total >= SHINGLE:
        run = np.full(total - SHINGLE + 1, SHINGLE, np.uint64)
        for j in range(SHINGLE):
            run = chain(run, words[j : total - SHINGLE + 1 + j])
        found[: len(run)] = run
    valid = np.arange(total) + SHINGLE <= np.repeat(ends[1:], sizes)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        short = np.full(1, sizes[i], np.uint64)
        for j in range(ends[i], ends[i + 1]):
            short = chain(short, words[j : j + 1])
        found[ends[i]], valid[ends[i]] = short[0], True
    found = found[valid]
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    _label(found, np.repeat(np.arange(len(sizes), dtype=np.uint64), counts))
    return found, np.concatenate([[0], np.cumsum(counts)])


def _label(found: np.ndarray, text: np.ndarray) -> None:
    """Give the second and further occurrences of a shingle in a text hashes of their own, in place."""
    inside = chain(found, text)
    ordered = np.sort(inside)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return
    low = np.uint64((1 << 20) - 1)
    flags = np.zeros(1 << 20, bool)
    flags[twice & low] = True
    at = np.flatnonzero(flags[inside & low])
    order = np.argsort(inside[at], kind="stable")
    at, run = at[order], inside[at][order]
    place = np.arange(len(run))
    occurrence = (place - np.maximum.accumulate(np.where(np.concatenate([[True], run[1:] != run[:-1]]), place, 0))).astype(np.uint64)
    found[at] = np.where(occurrence > 0, chain(found[at], occurrence), found[at])


def keys_of(found: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SKETCHES keys of each text: for each hash function its MINIMA smallest k-mers in text order. Texts without k-mers have keys of 0.

    Texts of like size share a matrix; a k-mer's hash is its product with an odd number, complemented, so that the padding's 0 is the largest.
    """
    counts = np.diff(ends)
    out = np.zeros((len(counts), SKETCHES), np.uint64)
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    by_size, at = counts[order], 0
    while at < len(order):
        end = int(np.searchsorted(by_size, by_size[at] * 1.25 + 4, side="right"))
        end = max(at + 1, min(end, at + CELLS // int(by_size[end - 1])))
        rows, size = order[at:end], by_size[at:end]
        at, width = end, int(size[-1])
        table = np.zeros((len(rows), width), np.uint64)
        table[np.arange(width) < size[:, None]] = found[ranges(ends[rows], size)]
        r = np.arange(len(rows))
        for f, odd in enumerate(_ODD):
            value = table * odd
            places = np.full((MINIMA, len(rows)), width)
            for j in range(min(MINIMA, width)):
                best = value.argmax(axis=1)
                value[r, best] = 0
                places[j] = np.where(size > j, best, width)
            key = np.full(len(rows), odd, np.uint64)
            for place in np.sort(places, axis=0):
                key = chain(key, np.where(place < width, table[r, np.minimum(place, width - 1)], np.uint64(0)))
            out[rows, f] = key
    return out


# ---- alignment ---------------------------------------------------------------------------------------------------------------------


def bins_of(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words of each text fall in each bin, a byte a bin."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    counts = np.bincount(text * BINS + (words >> np.uint64(40)).astype(np.int64) % BINS, minlength=(len(ends) - 1) * BINS)
    return np.minimum(counts, FULL).astype(np.uint8).reshape(-1, BINS)


def may_reach(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Which rows of bins in ``a`` can be as similar as ``least`` to those in ``b``: texts share at most the smaller count of each bin and, where both bins are full, the smaller number of words beyond."""
    beyond = np.minimum(size_a - a.sum(axis=1, dtype=np.int64), size_b - b.sum(axis=b.ndim - 1, dtype=np.int64))
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64) + beyond
    return most >= least / (1 + least) * (size_a + size_b) - 1e-6


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched items of the best banded alignment of two sequences without repeats over their union; 0 as soon as it can't reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    common, pa_, pb = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least / (1 + least) * (n + m)
    if len(common) < need - 1e-9:
        return 0.0
    order = np.argsort(pa_)
    x, y = pa_[order], pb[order]
    y = y[np.abs(x - y) <= _band(n, m, need)]
    if len(y) and not (np.diff(y) > 0).all():
        tails: list[int] = []
        for value in y.tolist():
            at = bisect_left(tails, value)
            tails[at : at + 1] = [value]
        matched = len(tails)
    else:
        matched = len(y)
    return matched / (n + m - matched)


def _band(n: int, m: int, need: float) -> int:
    """More insertions and deletions than this are too many."""
    return n + m - 2 * int(np.ceil(need - 1e-9))


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched words of the best banded alignment over the union; 0 as soon as it can't reach ``least``.

    The alignment is a longest common subsequence, a bit for each word of ``a`` and a step for each word of ``b``; matches outside the band don't count.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    need = least / (1 + least) * (n + m)
    if min(n, m) < need - 1e-9:
        return 0.0
    words, first, second = (np.unique(x, return_counts=True) for x in (np.concatenate([a, b]), a, b))
    counts = np.zeros((2, len(words[0])), np.int64)
    for row, (w, c) in zip(counts, (first, second)):
        row[np.searchsorted(words[0], w)] = c
    if counts.min(axis=0).sum() < need - 1e-9:
        return 0.0
    band = _band(n, m, need)
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    full, near = (1 << n) - 1, (1 << (2 * band + 1)) - 1
    open_ = full
    for j, w in enumerate(b.tolist()):
        match = where.get(w)
        if match:
            match &= near << (j - band) if j >= band else near >> (band - j)
            taken = open_ & match
            open_ = ((open_ + taken) | (open_ - taken)) & full
        if j & 1023 == 1023 and n - open_.bit_count() + m - j - 1 < need - 1e-9:
            return 0.0
    matched = n - open_.bit_count()
    return matched / (n + m - matched) if matched >= need - 1e-9 else 0.0


def _aligned(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words and shingles of a text of packed words."""
    words = np.frombuffer(packed, "<u4")
    return words, elements(words.astype(np.uint64), np.array([0, len(words)]))[0]


def _alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """What is alike in shingles is alike in words."""
    return similarity(x[1], y[1]) >= SIMILARITY or edit_similarity(x[0], y[0]) >= SIMILARITY


# ---- Spark -------------------------------------------------------------------------------------------------------------------------


def sketches(df: DataFrame, measure: tuple[str, Callable[[], Callable]] | None = None) -> DataFrame:
    """doc_id, others (the columns besides doc_id and text), node (128-bit hash of the words), keys, size (words), bins, words (32 bits each); no text.

    measure: a column's name and what makes, in each task, a function from an Arrow array of texts to that long column and what ``word_hashes`` gives, for operators that need more of the same texts.
    """
    others = [c for c in df.columns if c not in ("doc_id", "text")]
    rows = df.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *([F.struct(*others).alias("others")] if others else []))
    fields = [*rows.schema.fields[1:], *([T.StructField(measure[0], T.LongType())] if measure else []), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.LongType()), T.StructField("bins", T.BinaryType()), T.StructField("words", T.BinaryType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = measure[1]() if measure else None
        for whole in batches:
            for batch in slices(whole, 0):
                texts = batch.column(0)
                *values, words, ends = measured(texts) if measured else word_hashes(texts)
                more = [pa.array(v, pa.int64()) for v in values]
                found, cuts = elements(words, ends)
                keys = keys_of(found, cuts)
                narrow = (words >> np.uint64(32)).astype("<u4")
                both = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                has = np.diff(cuts) > 0
                offsets = np.concatenate([[0], np.cumsum(has * SKETCHES)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more, pa.array(_node_hashes(words, ends), pa.binary()), listed, pa.array(np.diff(ends)), pa.array([b.tobytes() for b in bins_of(words, ends)], pa.binary()), pa.array([narrow[s:e].tobytes() for s, e in both], pa.binary())], names=names)

    return rows.mapInArrow(run, T.StructType(fields))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose bins allow the similarity. nodes: node, size, bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3)]
            yield batch.select(["a", "b"]).filter(pa.array(may_reach(*sides, *(batch.column(i).to_numpy() for i in (4, 5)))))

    left, right = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bins").alias(f"bins_{x}")) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "bins_a", "bins_b", "size_a", "size_b")
    return both.mapInArrow(run, "a long, b long")


def _words_of(sketched: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, words of the wanted nodes (distinct, a stored table)."""
    return matched(sketched.select(F.col("row").alias("node"), "words"), wanted, "node")


def verify(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes that are similar enough. pairs: a stored table. A node in many pairs is a skewed join key, which Spark splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def of(node: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
            if node not in recent:
                recent[node] = _aligned(packed)
                if len(recent) > 8:
                    recent.popitem(last=False)
            recent.move_to_end(node)
            return recent[node]

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                a, b, wa, wb = (batch.column(i).to_pylist() for i in range(4))
                good = [i for i in range(len(a)) if _alike(of(a[i], wa[i]), of(b[i], wb[i]))]
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    words = _words_of(sketched, wanted)
    right, left = (words.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}")) for x in ("b", "a"))
    linked = materialize(pairs.join(right, "b").join(left, "a").select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long"), "verified")
    discard(wanted)
    return linked


def components(links: DataFrame) -> DataFrame:
    """node, class_node (the smallest node of its component) for every node of a link. Each round every node points to its smallest neighbour, pointers are followed to their roots, and only the links between
    different roots go on, so a round reads what the last one left and not all links again."""
    left = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "links")
    placed = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("end")).select("end.*")
        roots = _roots(materialize(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("class_node")), "classes"))
        a, b = (roots.select(F.col("node").alias(x), F.col("class_node").alias(f"class_{x}")) for x in ("a", "b"))
        between = left.join(a, "a").join(b, "b").where("class_a != class_b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
        rest = materialize(between.distinct(), "links")
        if placed is None:
            after = roots
        else:
            over = roots.select(F.col("node").alias("class_node"), F.col("class_node").alias("now"))
            after = materialize(placed.join(over, "class_node", "left").select("node", F.coalesce("now", "class_node").alias("class_node")), "classes")
            discard(placed, roots)
        discard(left)
        left, placed = rest, after
    if placed is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("class_node"))
    discard(left)
    return placed


def _roots(current: DataFrame) -> DataFrame:
    """node, class_node after all pointers (class_node, never larger than the node) have been followed to their ends. current: a stored table, which is discarded."""
    while True:
        further = current.select(F.col("node").alias("class_node"), F.col("class_node").alias("next")).where("class_node != next")
        if further.join(current.select("class_node"), "class_node", "left_semi").isEmpty():
            return current
        after = materialize(current.join(further, "class_node", "left").select("node", F.coalesce("next", "class_node").alias("class_node")), "classes")
        after, current = current, after
        discard(after)


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed (node, class_node, a stored table, which is discarded) after new links: classes are joined, not their members again."""
    a, b = (placed.select(F.col("node").alias(x), F.col("class_node").alias(f"class_{x}")) for x in ("a", "b"))
    between = links.join(a, "a").join(b, "b").where("class_a != class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    joined = components(between).select(F.col("node").alias("class_node"), F.col("class_node").alias("now"))
    after = materialize(placed.join(joined, "class_node", "left").select("node", F.coalesce("now", "class_node").alias("class_node")), "placed")
    discard(placed)
    return after


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one class."""
    keys = placed.groupBy("key").agg(F.min("class_node").alias("low"), F.max("class_node").alias("high")).where("low != high").select("key")
    return placed.join(keys, "key")


def _units(rows: DataFrame) -> DataFrame:
    """Every row of a bucket (key) once for each unit (key, low, high) that compares it. A bucket of more than ROWS_PER_BLOCK rows or WORDS_PER_BLOCK words is cut into blocks (side);
    each pair of blocks, or a block by itself, is a unit."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / ROWS_PER_BLOCK, F.sum("size") / WORDS_PER_BLOCK, F.lit(1.0))).cast("int")
    cut = rows.join(rows.groupBy("key").agg(blocks.alias("blocks")), "key").withColumn("side", F.pmod(F.hash("node"), F.col("blocks")))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "side").alias("low"), F.greatest(x, "side").alias("high"))))
    return cut.withColumn("unit", unit).select("key", F.col("unit.low").alias("low"), F.col("unit.high").alias("high"), "side", "node", "class_node", "size", "keys", "bins")


def _each_unit(units: DataFrame, schema: str, of: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``of`` gets the columns of one unit at a time: key, low, high, side, node, class, size, keys (a row of SKETCHES each) and the last column's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            columns.append(batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCHES))
            columns.append(batch.column(8).to_numpy(zero_copy_only=False))
            new = np.zeros(max(batch.num_rows - 1, 0), bool)
            for column in columns[:3]:
                new |= column[1:] != column[:-1]
            cuts = np.flatnonzero(new) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if end > start:
                    if group and any(group[0][i][0] != columns[i][start] for i in range(3)):
                        yield from of([np.concatenate(x) for x in zip(*group)])
                        group = []
                    group.append(tuple(c[start:end] for c in columns))
        if group:
            yield from of([np.concatenate(x) for x in zip(*group)])

    return units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, schema)


def _meet(i: int, part: slice, key, same_block, side, home, size, table) -> np.ndarray:
    """Those rows of ``part`` that a unit compares with row i: of another class and a fitting size, and told by this bucket, the first of those that both are in."""
    fits = (np.minimum(size[part], size[i]) >= SIMILARITY * np.maximum(size[part], size[i]) - 1e-6) & (home[part] != home[i])
    other = part.start + np.flatnonzero(fits if same_block else fits & (side[part] != side[i]))
    if len(other):
        same = table[other] == table[i]
        other = other[table[i][same.argmax(axis=1)] == key]
    return other


def _with_partners(units: DataFrame) -> DataFrame:
    """The rows of units that have a partner there which their bins allow: at most as many rows as there were, however many pairs there are."""

    def of(unit):
        key, low, high, side, node, home, size, table, packed = unit
        if (home == home[0]).all():
            return
        counts = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, BINS)
        has = np.zeros(len(node), bool)
        for i in range(1, len(node)):
            for at in range(0, i, COMPARED):
                other = _meet(i, slice(at, min(i, at + COMPARED)), key[0], low[0] == high[0], side, home, size, table)
                if has[i]:
                    other = other[~has[other]]
                if len(other):
                    good = other[may_reach(counts[other], counts[i], size[other], size[i])]
                    has[good] = True
                    has[i] |= len(good) > 0
        if has.any():
            offsets = pa.array(np.arange(0, SKETCHES * int(has.sum()) + 1, SKETCHES, dtype=np.int32))
            arrays = [*(pa.array(c[has]) for c in (key, low, high, side, node, home, size)), pa.ListArray.from_arrays(offsets, pa.array(table[has].ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "low", "high", "side", "node", "class_node", "size", "keys"])

    return _each_unit(units, "key long, low int, high int, side int, node long, class_node long, size long, keys array<long>", of)


def _joining(units: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of each unit: every pair of different classes is ruled out by its common words, aligned, or in one class by the links so far, so a unit gives
    fewer links than it has classes. units: the words of a row in the last column."""

    def of(unit):
        key, low, high, side, node, home, size, table, packed = unit
        if (home == home[0]).all():
            return
        home = np.unique(home, return_inverse=True)[1]
        order = np.lexsort((node, home, -np.bincount(home)[home]))  # larger classes first
        side, node, home, size, table, packed = side[order], node[order], home[order], size[order], table[order], packed[order]
        ends = np.concatenate([[0], np.cumsum(size)])
        words = np.frombuffer(b"".join(packed), "<u4").astype(np.uint64)
        _label(words, np.repeat(np.arange(len(node), dtype=np.uint64), size))
        distinct, words = np.unique(words, return_inverse=True)
        mine, of_text, a, b = np.zeros(len(distinct), bool), lru_cache(64)(lambda i: _aligned(packed[i])), [], []
        for i in range(1, len(node)):
            here = words[ends[i] : ends[i + 1]]
            mine[here] = True
            found = []
            for at in range(0, i, COMPARED):
                other = _meet(i, slice(at, min(i, at + COMPARED)), key[0], low[0] == high[0], side, home, size, table)
                if len(other):
                    sizes = size[other]
                    common = np.add.reduceat(mine[words[ranges(ends[other], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
                    reach = common >= SIMILARITY / (1 + SIMILARITY) * (sizes + size[i]) - 1e-6
                    found.append((common[reach] / sizes[reach], other[reach]))
            mine[here] = False
            if found:
                share, other = (np.concatenate(x) for x in zip(*found))
                for j in other[np.argsort(-share, kind="stable")].tolist():
                    if home[j] != home[i] and _alike(of_text(i), of_text(j)):
                        a.append(min(node[i], node[j]))
                        b.append(max(node[i], node[j]))
                        home[home == home[i]] = home[j]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _each_unit(units, "a long, b long", of)


def _decided_links(links: DataFrame, buckets: DataFrame, nodes: DataFrame, sketched: DataFrame) -> DataFrame:
    """node, class_node of the nodes in buckets (a stored table) after the pairs that the centres left out: all pairs of different classes in one bucket, compared where the bucket is. Words move only
    for rows with a partner that bins allow, and no pair is a row unless it is a link."""
    linked = components(links)
    placed = buckets.select("node").distinct().join(linked, "node", "left").select("node", F.coalesce("class_node", "node").alias("class_node"))
    placed = materialize(placed, "placed")
    rows = materialize(_mixed(buckets.join(placed, "node")), "mixed")
    near = materialize(_with_partners(_units(rows.join(nodes.select("node", "keys", "size", "bins"), "node"))), "near")
    wanted = materialize(near.select("node").distinct(), "wanted")
    worded = near.join(_words_of(sketched, wanted), "node").select(*near.columns, "words")
    new = materialize(_joining(worded), "joining")
    discard(rows, near, wanted)
    if not new.isEmpty():
        placed = _merged(placed, new)
    discard(new)
    return placed


def _decided(df: DataFrame, measure: tuple[str, Callable[[], Callable]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and for each node: node, class_id, class_size, kept_row."""
    sketched = materialize(sketches(df, measure).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # from here on a text is known by the number of its first row
    nodes = sketched.groupBy("node").agg(F.min(_first()).alias("first"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("bins").alias("bins"))
    nodes = materialize(nodes.withColumnRenamed("node", "text_hash").withColumn("node", F.col("first.row")), "nodes")
    by_key = nodes.select("node", "size", F.explode("keys").alias("key"))
    many = by_key.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialize(by_key.join(many, "key").select("key", "node", "size", "members"), "buckets")
    # the centre of a bucket is the node that shares most over all its buckets
    weight = buckets.groupBy("node").agg(F.sum("members").alias("weight"))
    centres = buckets.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("top")).select("key", F.col("top.node").alias("centre"), F.col("top.size").alias("centre_size"))
    fits = F.least("size", "centre_size") >= SIMILARITY * F.greatest("size", "centre_size") - 1e-6
    pairs = buckets.join(centres, "key").where("centre != node").where(fits)
    pairs = materialize(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct(), "pairs")
    likely = materialize(_plausible(pairs, nodes), "likely")
    links = verify(likely, sketched)
    placed = _decided_links(links, buckets.select("key", "node"), nodes, sketched)
    discard(likely, links, pairs, buckets)
    home = nodes.join(placed, "node", "left").select("text_hash", "first", "least_id", "copies", F.coalesce("class_node", "node").alias("class_node"))
    by_class = home.groupBy("class_node").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first").alias("kept"))
    home = materialize(home.join(by_class, "class_node").select(F.col("text_hash").alias("node"), "class_id", "class_size", F.col("kept.row").alias("kept_row")), "homes")
    discard(placed, nodes)
    return sketched, home


def classified(df: DataFrame, measure: tuple[str, Callable[[], Callable]] | None = None) -> DataFrame:
    """doc_id, class_id, class_size, class_row (tells classes apart where all ids of a class are null), row, the measure, if any, and others, a struct of df's other columns, if any: one row for each row of df."""
    sketched, home = _decided(df, measure)
    extra = [c for c in (*([measure[0]] if measure else []), "others") if c in sketched.columns]
    return sketched.select("doc_id", "node", "row", *extra).join(home, "node").select("doc_id", "class_id", "class_size", F.col("kept_row").alias("class_row"), "row", *extra)


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, is_kept (the row with the class's smallest id stays): one row for each row of df (doc_id, text)."""
    return classified(df.select("doc_id", "text")).select("doc_id", "class_id", "class_size", (F.col("row") == F.col("class_row")).alias("is_kept"))


def keep_first(df: DataFrame) -> DataFrame:
    """The rows and columns of df without all but one row of each class: the one with the smallest id, the first of equal ones by their other columns.

    Texts are not stored again: the row that stays is known by its id and the hash of its words.
    """
    sketched, home = _decided(df.select("doc_id", "text"))
    kept = sketched.join(home.select(F.col("kept_row").alias("row")), "row", "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"))
    named = df.select(F.col("doc_id").cast("long").alias("kept_id"), F.struct(*df.columns).alias("line"))
    fields = [*named.schema.fields, T.StructField("kept_node", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).flatten()[df_text].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_node_hashes(*word_hashes(texts)), pa.binary())], names=[f.name for f in fields])

    df_text = df.columns.index("text")
    rows = named.mapInArrow(run, T.StructType(fields))
    stays = rows.join(kept, rows.kept_id.eqNullSafe(kept.kept_id) & (rows.kept_node == kept.kept_node), "left_semi")
    order = F.struct(*[F.col(f"line.{f.name}").alias(f"c{i}") for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.AtomicType)])
    return stays.groupBy("kept_id", "kept_node").agg(F.min_by("line", order).alias("line")).select("line.*")


def _node_hashes(words: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(words[s:e].tobytes()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _first():
    """Orders rows by id, null ids last, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
