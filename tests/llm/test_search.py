"""Ranked lexical search against a plain version, and what its blocks skip."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("framewright.llm")
from pyspark.sql import functions as F

from framewright.llm import lexical_search as L

FOLDER = "/root/testdata/sf0.001"
_UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))


def plain(docs, items, k=20):
    """Scores every row for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    rows, total = len(counted), sum(n for *_, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 75 + 25 * n * rows // total
            score = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def same(found, wanted):
    assert sorted(map(str, ((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()))) == sorted(map(str, wanted))


def test_whole_table_equals_a_plain_ranking(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    same(L.op11_lexical_search(spark, FOLDER), plain(docs, items))


def test_odd_rows_ties_and_small_segments(spark, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(L, "QUERIES_A_BLOCK", 2)
    monkeypatch.setattr(L, "SEEDS", 2)
    words = ["Alpha", "béta", "gamma1", "δέλτα", "x", "y", "z", "ZULU"]
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(1, 30)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "... !!"), (None, "alpha x y"), (7, "alpha x y"), (7, "alpha x y"), (503, "alpha x y"), (504, "alpha\x00x_y" * 3), (505, "zulu " * 60_000)]
    items = [(0, "alpha x Y"), (1, "ALPHA alpha β δέλτα"), (2, None), (3, ""), (4, "nowhere"), (5, "zulu z"), (5, "x"), (None, "béta gamma1 béta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("t")).withColumn("score", F.lit(1)).repartition(3, "doc_id")
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    same(L.rank(frame, asked), plain(docs, items))
    same(L.rank(frame, asked, 3), plain(docs, items, 3))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.rank(none, some).collect() == []
    assert L.rank(some.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert L.rank(some.select(F.col("item_id").alias("doc_id"), F.lit(None).cast("string").alias("text")), some).collect() == []


def test_variable_length_bytes_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, 5], np.int64)
    data, sizes = L.pack(values)
    assert L.unpack(data).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 6, 1]
    assert L.unpack(L.pack(np.zeros(0, np.int64))[0]).tolist() == []


def test_term_counts_of_sliced_columns():
    texts = ["a b", None, "", "Ünï x-y", "...", "end", "begin "]
    assert L.term_counts(pa.array(texts)).tolist() == [len(terms(t)) for t in texts]
    assert L.term_counts(pa.array(texts).slice(3, 3)).tolist() == [3, 0, 1]


def test_low_blocks_are_never_decompressed():
    """One row has the rare term often: blocks of the common term far from it can't reach the best scores."""
    segment = L.Segment()
    texts = ["rare " * 9 + "common" if 5000 <= i < 5020 else "common filler" for i in range(8000)]
    for start in range(0, len(texts), 1000):
        segment.take(pa.array(range(start, start + 1000), pa.int64()), texts[start : start + 1000])
    lines = [r for b in segment.lines(0, 8000, 16200) for r in b.to_pylist()]
    m = L.norm(np.array(lines[0]["lengths"]), 8000, 16200)
    by_term = {r["term"]: L.Postings(r["postings"], *(np.array(r[c]) for c in ("ends", "firsts", "lasts", "impacts"))) for r in lines[1:]}
    query = [(by_term["rare"], 5966), (by_term["common"], 1)]
    place, score = L.best(query, m, np.arange(8000), np.zeros(8000, bool))
    assert sorted(place.tolist()) == list(range(5000, 5020)) and len(set(score.tolist())) == 1
    assert len(by_term["common"].lasts) == 63 and len(by_term["common"].read) < 20
