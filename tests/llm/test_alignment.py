"""Alignment of two tokenizers against a plain version of groups, links and counts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("framewright.llm")
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import cross_alignment as C

FOLDER = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  two  blanks ", "a\nb\r\n\tc", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ mark", "in▁side", "née ﬁ ½  x", "你好 \U0001f600\U0001f468‍\U0001f469", "\x00\x01", "1234567890 12", "it's we'LL", "x" * 5000, "same", "same", " " * 300 + "end"]


def plain(rows):
    """Rows of the contract from token strings, span by span."""
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    letters = C._byte_letters()

    def spans(sizes):
        at = np.cumsum([0, *sizes]).tolist()
        return list(zip(at, at[1:]))

    out = []
    for doc_id, text in rows:
        ids_a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b_side.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_side.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((doc_id, [], [], [], []))
            continue
        spans_a, spans_b = spans(map(len, bytes_a)), spans(map(len, bytes_b))
        links, first = [], 0
        for i, (s, e) in enumerate(spans_a):
            while spans_b[first][1] <= s:
                first += 1
            j = first
            while j < len(spans_b) and spans_b[j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups = [([i for i, (s, e) in zip(ids_a, spans_a) if lo <= s < hi], [i for i, (s, e) in zip(ids_b, spans_b) if lo <= s < hi]) for lo, hi in zip([0, *cuts], cuts)] if len(text) < 6000 else None
        out.append((doc_id, ids_a, ids_b, groups, links))
    counts = Counter(p for *_, links in out for p in set(links))
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    result = []
    for doc_id, ids_a, ids_b, groups, links in out:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ("" if not links else None)
        result.append((doc_id, len(ids_a), len(ids_b), len(groups) if groups is not None else None, len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return result


def same(found, wanted):
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
    for doc_id, *want in wanted:
        rows = got[doc_id]
        match = next(i for i, row in enumerate(rows) if all(w is None or g == w for g, w in zip(row, want)))
        rows.pop(match)
    assert not any(got.values())


def test_whole_table_equals_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = C.op12_cross_alignment(spark, FOLDER)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(found.collect(), plain(rows))


@pytest.mark.parametrize("frequent", [4_000_000, 20, 0])
def test_odd_rows_whatever_is_sent_to_all_tasks(spark, monkeypatch, frequent):
    """Pairs that aren't sent to all tasks meet their counts by the join."""
    monkeypatch.setattr(C, "FREQUENT", frequent)
    monkeypatch.setattr(C, "HELD_PAIRS", 50)
    rows = [*enumerate(ODD), (None, "no id"), (3, "again 3"), (3, "again 3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n_a", F.lit(9)).repartition(3)
    same(C.align(frame).collect(), plain(rows))


def test_empty_table_and_texts_without_tokens(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.align(none).collect() == [] and C.token_groups(none).collect() == []
    found = C.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_cover_every_byte_and_hold_the_same_bytes_on_both_sides(spark):
    texts = [(i, t) for i, t in enumerate(ODD)]
    pair = C.tokenizer_pair(*C.default_paths())
    by_text = {}
    for r in C.token_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        by_text.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        groups = sorted(by_text.get(i, []), key=lambda r: r.start)
        if groups:
            raw = (" " + t).encode()
            assert groups[0].start == 0 and groups[-1].end == len(raw) and all(x.end == y.start for x, y in zip(groups, groups[1:]))
            for g in groups:
                assert b"".join(pair.a.bytes[x] for x in g.a) == raw[g.start : g.end] == b"".join(pair.b.bytes[x] for x in g.b)
    assert 9 in by_text and 6 not in by_text  # a mark in a text isn't given back


def test_both_libraries_agree_on_long_runs():
    pair = C.tokenizer_pair(*C.default_paths())
    assert pair.a.fast
    for text in (" " * 50_000, "x" * 50_000, "\n" * 3000 + " é" * 3000, " \u0085᠎​　 a", "1٠² ǅͅ"):
        pair.a.check([text])
