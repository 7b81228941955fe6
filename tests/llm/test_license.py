"""Licence notices against a plain search: base phrases word by word, errors by a table of edit distances over the whole text."""

import random
import re

import pytest

pytest.importorskip("framewright.llm")
from pyspark.sql import functions as F

from framewright.llm import license_scan as S

FOLDER = "/root/testdata/sf0.001"
_UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))


def plain_base(text):
    words = words_of(text)
    at = [(i, label) for phrase, label in S.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def edits_to(notice, words):
    """The fewest edits from the notice to any run of whole words, or None if more than it allows; the exact start must stand at the run's start."""
    text = " ".join(words)
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    fixed, rest = notice.words[: notice.exact], notice.words[notice.exact :]
    best = None
    for s in starts:
        if not text.startswith(fixed, s):
            continue
        begin = s + len(fixed)
        row = list(range(len(rest) + 1))
        for j, c in enumerate(text[begin : begin + len(rest) + notice.edits + 1], begin):
            if (j == len(text) or text[j] == " ") and j > s and row[-1] <= notice.edits:
                best = min(best if best is not None else 99, row[-1])
            new = [row[0] + 1]
            for i, r in enumerate(rest, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != r)))
            row = new
        if begin + len(rest) + notice.edits >= len(text) and row[-1] <= notice.edits:
            best = min(best if best is not None else 99, row[-1])
    return best


def test_whole_table_equals_a_plain_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = {r.doc_id: r for r in S.op13_license_scan(spark, FOLDER).collect()}
    assert len(found) == len(docs)
    for doc_id, text in docs:
        r = found[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and (r.score == 1.0) == (r.n_base > 0 or r.score == 1.0)
    assert any(r.labels for r in found.values())


def damaged(draw, text, n):
    for _ in range(n):
        i = draw.randrange(len(text))
        text = {0: text[:i] + text[i + 1 :], 1: text[:i] + draw.choice("abcxyz ") + text[i:], 2: text[:i] + draw.choice("abcxyz") + text[i + 1 :]}[draw.randrange(3)]
    return text


def test_errors_up_to_the_bound_are_found_and_no_more():
    draw, filler = random.Random(5), "the of general software license notice public free may use copies permission mit under file".split()
    own, with_errors, beyond = S.Scanner(), 0, 0
    for notice in S.NOTICES:
        for n in range(notice.edits + 3):
            text = " ".join(draw.choices(filler, k=6)) + " " + damaged(draw, notice.words, n) + " " + " ".join(draw.choices(filler, k=6))
            folded, _ = S.fold(text)
            found = own.matches(folded, own.places(folded)[1])
            for i, other in enumerate(S.NOTICES):
                best = edits_to(other, words_of(text))
                mine = [edits for of, *_, edits in found if of == i]
                assert bool(mine) == (best is not None), (text, other)
                if mine:
                    assert best <= min(mine) <= other.edits
            with_errors += any(edits for *_, edits in found)
            beyond += not found
    assert with_errors > 40 and beyond > 5


def test_labels_of_the_method_and_words_that_only_look_alike(spark):
    texts = ["Released under the MIT Licence.", "Licenced under the Apache Lisense, Version 2.0", "GNU Genral Public Licence v3", "unit license, permit licenses, omit license", "Licensed under CC BY-NC 4.0.", "all in general, the public has a licence"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in S.summarize(frame).collect()}
    assert [found[i].labels for i in range(6)] == ["mit", "apache", "gpl", "", "cc", ""]
    assert all(found[i].n_base == 0 for i in range(6)) and 0.8 < found[0].score < 1.0 and found[3].score == 0.0 and found[4].score == 1.0


def test_spans_are_cut_from_the_text(spark):
    text = "Intro — é.\nReleased under the  MIT\n(Licence)! Then: GNU General-Public\tLicense."
    rows = S.scan(spark.createDataFrame([(1, text), (2, None), (None, "no notice")], "doc_id long, text string")).collect()
    assert {(r.label, r.found, r.edits, r.first_word, r.last_word) for r in rows} == {("mit", "MIT\n(Licence", 1, 6, 7), ("gpl", "General-Public\tLicense", 0, 10, 12)}
    assert all(text[r.start : r.end] == r.found for r in rows)


def test_odd_rows(spark):
    long = "word " * 50_000 + "mit license " * 3000
    rows = [(1, None), (2, ""), (3, "...\x00"), (4, "MIT License"), (4, "MIT License"), (None, "Apache-License; MIT license mit license"), (5, long), (6, "mit licensee apache licenses"), (7, "x" * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("l")).withColumn("score", F.lit(2)).repartition(3)
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in S.summarize(frame).collect()), key=str)
    assert found == sorted(((i, *plain_base(t)) for i, t in rows), key=str)
    assert S.summarize(spark.createDataFrame([], "doc_id long, text string")).collect() == [] == S.scan(spark.createDataFrame([], "doc_id long, text string")).collect()
