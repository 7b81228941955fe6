"""Operator 11: ranked lexical search over segments of postings with Block-Max WAND.

Rows are dealt to segments of bounded size. A segment has one line for each of its terms: postings in blocks of ``BLOCK`` (gaps of places and occurrences as variable-length bytes), and for each block
its first and last place and its largest impact, which is the score of its best posting without the term's weight. So nothing of a segment's postings is shuffled to build it; document frequencies add up over segments.

A query's blocks cut a segment's places into spans in which no term changes its block. Shallow moves look up the block of each term by places only; the sum of weight times largest impact bounds a span's
scores. Spans are scored from the highest bound down, in steps, and only their blocks are decompressed; those whose bound is below the query's ``k``-th score so far are never read. What a sixteenth of the segments
(``SEEDS``) finds first gives every query a floor to start from, which is a score that ``k`` rows have, so the result is exact. Queries go through the segments in blocks; a task holds one segment and one block of queries.

A term is a maximal run of ASCII letters and digits and characters beyond ASCII, only A-Z lower-cased; scores are integers (see ``impact``). Null and empty texts have no terms and are never found, nor are they counted.
Rows of a null id are counted and found, after equal scores with an id. Repeated rows count and are found as often as they occur. Each row of the queries is ranked on its own, repeated or not; those without a term
that occurs have no rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import MOST_BROADCAST, discard, documents, matched, materialize, ranges, slices

BLOCK = 128
#: A segment ends at so many bytes of text or rows; a single longer text is a segment of its own.
SEGMENT_BYTES, SEGMENT_ROWS = 24 << 20, 1 << 16
QUERIES_A_BLOCK = 256
SEEDS = 16
FIRST_SPANS = 16
TOP = 20
_TERM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _TERM[b] else 32 for b in range(256))

INDEX_SCHEMA = "segment long, term string, df long, postings binary, ends array<int>, firsts array<int>, lasts array<int>, impacts array<long>, doc_ids array<long>, lengths array<long>"
_INDEX_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("postings", pa.binary()), ("ends", pa.list_(pa.int32())), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def terms_of(text: str | None) -> list[bytes]:
    # blanks are all that the table leaves of other ASCII characters
    return text.encode().translate(_FOLD).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's score without its term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def norm(n: np.ndarray, rows: int, terms: int) -> np.ndarray:
    return 75 + (25 * n * rows) // max(1, terms)


# ---- building ---------------------------------------------------------------------------------------------------------------


def term_counts(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text, from its bytes."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(len(texts), np.int64)
    inside = _TERM[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1] - offsets[0]
    firsts = starts[starts < len(inside)]
    begins[firsts] = inside[firsts]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets - offsets[0]])


def corpus_size(df: DataFrame) -> tuple[int, int]:
    """How many rows have a term, and how many terms they have together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = terms = 0
        for batch in batches:
            for part in slices(batch, 0):
                n = term_counts(part.column(0))
                rows, terms = rows + int(np.count_nonzero(n)), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([terms])], names=["rows", "terms"])

    found = df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "rows long, terms long").agg(F.sum("rows").alias("rows"), F.sum("terms").alias("terms")).first()
    return found.rows or 0, found.terms or 0


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative numbers, seven bits each, the last one without the high bit; and the number of bytes of each."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= (1 << bits)
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > i)
        out[at[some] + i] = ((values[some] >> (7 * i)) & 127) | np.where(sizes[some] > i + 1, 128, 0)
    return out, sizes


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, starts)


class Segment:
    """Postings of the rows taken so far."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # term, place, occurrences
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.rows = self.bytes = 0

    def take(self, ids: pa.Array, texts: list[str | None]) -> None:
        words = [terms_of(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
        table = np.array([self.known.setdefault(w, len(self.known)) for w in coded.dictionary.to_pylist()], np.int64)
        term = table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(self.rows, self.rows + len(texts)), n)
        key, tf = np.unique(term << 32 | place, return_counts=True)
        self.parts.append(((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)))
        self.ids.append(ids)
        self.lengths.append(n)
        self.rows += len(texts)

    def lines(self, number: int, rows: int, terms: int) -> Iterator[pa.RecordBatch]:
        """The line of ids and lengths, under no term, and one line for each term, in the order of terms."""
        lengths = np.concatenate(self.lengths)
        m = norm(lengths, rows, terms)
        yield pa.RecordBatch.from_pylist([{"segment": number, "doc_ids": pa.concat_arrays(self.ids).to_pylist(), "lengths": lengths.tolist()}], schema=_INDEX_ARROW)
        names = sorted(self.known)
        rank = np.empty(len(names), np.int64)
        rank[[self.known[w] for w in names]] = np.arange(len(names))
        term, place, tf = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        term = rank[term]
        order = np.argsort(term, kind="stable")  # places ascend within a term
        term, place, tf = term[order], place[order].astype(np.int64), tf[order].astype(np.int64)
        df = np.bincount(term, minlength=len(names))
        first = np.cumsum(df) - df
        blocks = -(-df // BLOCK)
        begin = np.repeat(first, blocks) + BLOCK * ranges(np.zeros(len(df), np.int64), blocks)
        size = np.minimum(begin + BLOCK, np.repeat(first + df, blocks)) - begin
        if not len(term):
            return
        gap = np.diff(place, prepend=0)
        gap[begin] = place[begin]  # each block begins anew
        # a block's gaps, then its occurrences
        where = np.repeat(2 * begin, size) + (np.arange(len(place)) - np.repeat(begin, size))
        values = np.empty(2 * len(place), np.int64)
        values[where], values[where + np.repeat(size, size)] = gap, tf - 1
        data, width = pack(values)
        byte_end = np.cumsum(width)[2 * (begin + size) - 1]
        largest = np.maximum.reduceat(impact(tf, m[place]), begin)
        block_start = np.concatenate([[0], np.cumsum(blocks)])
        term_byte = np.concatenate([[0], byte_end[block_start[1:] - 1]])
        inside = (byte_end - np.repeat(term_byte[:-1], blocks)).astype(np.int32)
        first_place, last = place[begin].astype(np.int32), place[begin + size - 1].astype(np.int32)
        for at in range(0, len(names), 50_000):
            part = slice(at, min(at + 50_000, len(names)))
            b = slice(block_start[part.start], block_start[part.stop])
            starts = pa.array((block_start[part.start : part.stop + 1] - b.start).astype(np.int32))
            none = pa.nulls(part.stop - part.start, pa.list_(pa.int64()))
            bytes_at = (term_byte[part.start : part.stop + 1] - term_byte[part.start]).astype(np.int32)
            payload = pa.Array.from_buffers(pa.binary(), part.stop - part.start, [None, pa.py_buffer(bytes_at.tobytes()), pa.py_buffer(data[term_byte[part.start] : term_byte[part.stop]].tobytes())])
            columns = [pa.array(np.full(part.stop - part.start, number)), pa.array([w.decode() for w in names[part]], pa.string()), pa.array(df[part]), payload]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(starts, pa.array(x[b])) for x in (inside, first_place, last, largest)], none, none], schema=_INDEX_ARROW)


def segments(df: DataFrame, rows: int, terms: int) -> DataFrame:
    """INDEX_SCHEMA: a line for every term of every segment, and one with null term that has the ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 24, Segment()
        for whole in batches:
            for batch in slices(whole, 1, rows=2000):
                size = int(pc.sum(pc.binary_length(batch.column(1))).as_py() or 0)
                if open_.rows and (open_.bytes + size > SEGMENT_BYTES or open_.rows + batch.num_rows > SEGMENT_ROWS):
                    yield from open_.lines(number, rows, terms)
                    number, open_ = number + 1, Segment()
                open_.take(batch.column(0), batch.column(1).to_pylist())
                open_.bytes += size
        if open_.rows:
            yield from open_.lines(number, rows, terms)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX_SCHEMA)


# ---- searching --------------------------------------------------------------------------------------------------------------


class Postings:
    """A term's blocks in one segment; those that were asked for are kept decompressed."""

    def __init__(self, postings: bytes, ends: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, impacts: np.ndarray):
        self.data, self.ends, self.firsts, self.lasts, self.impacts = np.frombuffer(postings, np.uint8), ends, firsts, lasts, impacts
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of a block."""
        if i not in self.read:
            values = unpack(self.data[self.ends[i - 1] if i else 0 : self.ends[i]])
            n = len(values) // 2
            place = np.cumsum(values[:n])
            self.read[i] = place, impact(values[n:] + 1, m[place])
        return self.read[i]


def best(query: list[tuple[Postings, int]], m: np.ndarray, ids: np.ndarray, missing: np.ndarray, floor: int = 0, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows of a segment, or all with a score above 0 and at least ``floor``. query: postings and weights; ids, missing: of the rows, for ties."""
    ends = np.unique(np.concatenate([x for p, _ in query for x in (p.lasts, p.firsts - 1)]))
    ends = ends[ends >= 0]
    at = []  # shallow moves: each term's block in each span, or the number of its blocks
    bound = np.zeros(len(ends), np.int64)
    for p, w in query:
        block = np.searchsorted(p.lasts, ends)
        block[np.append(p.firsts, ends[-1] + 1)[block] > ends] = len(p.lasts)
        bound += w * np.append(p.impacts, 0)[block]
        at.append(block)
    order = np.argsort(-bound, kind="stable")
    starts = np.concatenate([[0], ends[:-1] + 1])
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, step, least = 0, FIRST_SPANS, max(1, floor)
    while done < len(order):
        some = order[done : done + step]
        some = some[bound[some] >= least]
        if not len(some):
            break
        done, step = done + step, 2 * step
        wanted = np.zeros(int(ends[-1]) + 2, np.int64)
        wanted[starts[some]] += 1
        wanted[ends[some] + 1] -= 1
        wanted = np.cumsum(wanted) > 0
        total = np.zeros(len(wanted), np.int64)
        for (p, w), block in zip(query, at):
            for b in np.unique(block[some]).tolist():
                if b < len(p.lasts):
                    place, score = p.block(b, m)
                    total[place] += w * score
        total[~wanted] = 0  # spans that were not asked for have only some of their terms
        new = np.flatnonzero(total >= least)
        found, scores = np.concatenate([found, new]), np.concatenate([scores, total[new]])
        if len(found) > k:
            keep = np.lexsort((ids[found], missing[found], -scores))[:k]
            found, scores = found[keep], scores[keep]
        if len(found) >= k:
            least = max(least, int(scores.min()))
    return found, scores


def search(index: DataFrame, wanted: DataFrame, blocks: int = 1, k: int = TOP) -> DataFrame:
    """query, doc_id, score: the k best rows of every segment for every query. wanted: block (below ``blocks``), term, w, users (query, times, floor)."""

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_null(table["term"]))
        doc_ids = pa.concat_arrays(head["doc_ids"].chunks).flatten()
        m = head["m"].combine_chunks().flatten().to_numpy()
        missing = np.asarray(pc.is_null(doc_ids))
        ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
        queries: dict[int, list[tuple[Postings, int]]] = {}
        floors: dict[int, int] = {}
        lines = table.filter(pc.is_valid(table["term"]))
        for i in range(lines.num_rows):
            line = {c: lines[c][i] for c in ("postings", "ends", "firsts", "lasts", "impacts", "w", "users")}
            postings = Postings(line["postings"].as_py(), *(line[c].values.to_numpy() for c in ("ends", "firsts", "lasts", "impacts")))
            for user in line["users"].as_py():
                queries.setdefault(user["query"], []).append((postings, line["w"].as_py() * user["times"]))
                floors[user["query"]] = user["floor"]
        out = [(q, *best(terms, m, ids, missing, floors[q], k)) for q, terms in queries.items()]
        place = np.concatenate([np.zeros(0, np.int64), *[f for _, f, _ in out]])
        query = np.repeat([q for q, *_ in out], [len(f) for _, f, _ in out]) if out else place
        return pa.table({"query": pa.array(query, pa.int64()), "doc_id": pa.array(ids[place], pa.int64(), mask=missing[place]), "score": pa.array(np.concatenate([np.zeros(0, np.int64), *[s for *_, s in out]]))})

    line = ["postings", "ends", "firsts", "lasts", "impacts"]
    terms = index.where("term IS NOT NULL").select("segment", "term", *line)
    few = wanted.count() <= MOST_BROADCAST
    met = terms.join(F.broadcast(wanted) if few else wanted.hint("merge"), "term")
    # the line of ids goes to every block of queries
    headed = index.where("term IS NULL").select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "doc_ids", F.col("lengths").alias("m"))
    kinds = dict(met.dtypes)
    both = met.select("segment", "block", "term", *line, "w", "users", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<long>").alias("m")).unionByName(headed.select("segment", "block", "doc_ids", "m", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("term", *line, "w", "users")]))
    return both.groupBy("segment", "block").applyInArrow(run, "query long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """query (a number of the row), item_id, term, times: the distinct terms of each row of queries (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, item, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = pa.array(terms_of(text), pa.binary()).value_counts()
                if len(words):
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(words)), pa.array([item] * len(words), pa.int64()), words.field(0).cast(pa.string()), words.field(1)], names=["query", "item_id", "term", "times"])

    return queries.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "query long, item_id long, term string, times long")


def rank(df: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of df (doc_id, text) for every row of queries (item_id, text)."""
    rows, terms = corpus_size(df)
    index = materialize(segments(df, rows, terms), "lexical-index")
    asked = materialize(query_terms(queries), "lexical-queries")
    blocks = max(1, -(-asked.select("query").distinct().count() // QUERIES_A_BLOCK))
    frequency = matched(index.where("term IS NOT NULL").select("term", "df"), asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("n"))
    weights = frequency.select("term", F.floor(1000 * F.log((2.0 * rows + 2) / (2 * F.col("n") + 1))).cast("long").alias("w"))
    weighed = materialize(asked.join(weights, "term").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("long")), "lexical-weights")
    normed = index.withColumn("lengths", F.expr(f"transform(lengths, n -> 75 + (25 * n * {rows}L) div {max(1, terms)}L)"))

    def grouped(lines: DataFrame) -> DataFrame:
        return lines.groupBy("block", "term").agg(F.first("w").alias("w"), F.collect_list(F.struct("query", "times", "floor")).alias("users"))

    seeds = normed.where(F.pmod(F.xxhash64("segment"), F.lit(SEEDS)) == 0)
    floors = _ranked(search(seeds, grouped(weighed.withColumn("floor", F.lit(0).cast("long"))), blocks, k), k).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    floored = materialize(weighed.join(floors, "query", "left").fillna({"floor": 0}), "lexical-floors")
    names = asked.select("query", "item_id").distinct()
    out = materialize(_ranked(search(normed, grouped(floored), blocks, k), k).join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-ranks")
    discard(index, asked, weighed, floored)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
q AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(ws) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ws FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term), s),
m AS (SELECT r, doc_id, 75 + (25 * len(ws)::BIGINT * n) // l AS m FROM d, s WHERE len(ws) > 0),
p AS (SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
