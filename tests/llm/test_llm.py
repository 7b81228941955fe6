"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and the awkward inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("framewright.llm")
import public_tokenizers
from pyspark.sql import functions as F

from framewright.llm import byte_cnn, html_main_text, lm_scoring, near_dedup, packing, quality_ledger, sentencepiece_codec, token_store, toxicity, transport_stream

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (None, "no id here", "en", "s", 1), (2, "", "en", "s", 0), (3, "x" * 30_000 + "é", "de", "s", 1), (4, "same words in both of these rows", "en", "s", 1), (5, "same words in both of these rows", "en", "s", 1), (5, "same words in both of these rows", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit(1)).withColumn("row", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1


def test_unigram_matches_the_library_word_by_word(docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    enc = sentencepiece_codec.encoder(sentencepiece_codec.default_model_path())
    model = pb.ModelProto()
    with open(sentencepiece_codec.default_model_path(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, enc.v.scores):
        piece.score = float(score)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = {w for r in docs.select("text").limit(40).collect() for w in r.text.split()} | {"你好", "\U0001f600\U0001f600", "z" * 60, "Жзß", "a  b", " lead"}
    for w in words:
        assert np.frombuffer(enc.encode([w])[0], "<i4").tolist() == library.encode(w), w


def test_unigram_of_whole_texts_up_to_ties(docs, monkeypatch):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    enc = sentencepiece_codec.encoder(sentencepiece_codec.default_model_path())
    model = pb.ModelProto()
    with open(sentencepiece_codec.default_model_path(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, enc.v.scores):
        piece.score = float(score)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [r.text for r in docs.limit(80).collect()] + ["&&& &&&&& a   b", "", " "]
    same = 0
    for text, got in zip(texts, enc.encode(texts)):
        ids, want = np.frombuffer(got, "<i4"), np.array(library.encode(text), int)
        same += ids.tolist() == want.tolist()
        assert enc.v.scores[ids].sum(dtype=np.float64) == pytest.approx(enc.v.scores[want].sum(dtype=np.float64), rel=1e-6)
    assert same > 0.9 * len(texts)
    alone = sentencepiece_codec.Encoder(enc.v)
    monkeypatch.setattr(sentencepiece_codec, "LONGEST_IN_BATCH", 0)
    assert alone.encode(texts) == sentencepiece_codec.Encoder(enc.v).encode(texts) == enc.encode(texts)


def test_ties_and_vocabularies():
    make = lambda pieces, kinds=None: sentencepiece_codec.compile_vocabulary(sentencepiece_codec.Vocabulary(["<unk>", *pieces], np.array([0.0] + [-1.0] * len(pieces), np.float32), [2, *(kinds or [1] * len(pieces))], False))
    enc = sentencepiece_codec.Encoder(make(["a", "aa", "b"]))
    assert np.frombuffer(enc.encode(["aaa"])[0], "<i4").tolist() == [1, 2] and np.frombuffer(enc.encode(["aac"])[0], "<i4").tolist() == [2, 0]
    with pytest.raises(ValueError):
        make(["a▁b"])
    with pytest.raises(ValueError):
        make(["a", "x"], [1, 4])


def test_sentencepiece_round_trip(spark, docs, odd, empty):
    path = sentencepiece_codec.default_model_path()
    for df, n in ((docs, 200), (odd, len(ODD)), (empty, 0)):
        out = sentencepiece_codec.encode_documents(df, path)
        assert out.count() == n and out.where("NOT round_trip").count() == 0
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs, path), path).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.where("text <> t").count() == 0


# ---- 2


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 20_000))
    table = token_store.PerfectHash.from_bytes(token_store.PerfectHash.build(keys).to_bytes())
    assert sorted(table.index(keys).tolist()) == list(range(len(keys)))


def test_store_gives_back_the_library_ids(spark, docs, odd, empty, tmp_path):
    path = token_store.default_tokenizer_path()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for k, df in enumerate((docs, odd, empty)):
        manifest = token_store.write_store(df, path, f"file://{tmp_path}/{k}", shards=3)
        got = token_store.read_store(manifest).orderBy("start").collect()
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        start = 0
        for g, r in zip(got, rows, strict=True):
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    shard = token_store.Shard(token_store.write_store(docs, path, f"file://{tmp_path}/x", shards=1).first()["path"])
    assert shard.lookup(7)[0][-1] == 2 and shard.lookup(10**12) == []


@pytest.mark.parametrize("text", ["'s don't İstanbul Σας ﬁ x<|endoftext|>y a\tb\x1cc", "n²½ Ⅷ ß ẞ", "", "\n\n", "é ́"])
def test_word_encoder_matches_the_library(text):
    enc = token_store.word_encoder(token_store.default_tokenizer_path())
    assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_library_ids_of_whole_texts(docs, tmp_path, monkeypatch):
    import json

    path = token_store.default_tokenizer_path()
    texts = [r.text for r in docs.limit(100).collect()] + [None, "", " ", "\n x"]
    with open(path, encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].pop()  # a file that keeps case is encoded by the library alone
    (tmp_path / "other.json").write_text(json.dumps(other))
    for file, by_words in ((path, True), (str(tmp_path / "other.json"), False)):
        enc = token_store.WordEncoder(file)
        assert enc.by_words == by_words
        for most in (700_000, 500):
            monkeypatch.setattr(token_store, "REMEMBERED_CHUNKS", most)
            ids, ends = enc.encode(texts)
            want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert [x.tolist() for x in np.split(ids, ends[1:-1])] == want
    enc.check(texts)
    monkeypatch.setattr(token_store, "_NORMALIZER", other["normalizer"])
    wrong = token_store.WordEncoder(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        wrong.check(["An Upper case text"])


def test_equal_rows_are_cut_into_shards(spark, tmp_path):
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text again").alias("text"))
    manifest = token_store.write_store(df, token_store.default_tokenizer_path(), f"file://{tmp_path}/h", shards=4)
    assert max(r.n_records for r in manifest.collect()) < 2000 and token_store.read_store(manifest).count() == 4000


# ---- 3


def brute_measures(text):
    import re

    words = re.findall("[^ \t-\r]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_measures_and_policies(spark, docs, odd, empty):
    for r in docs.select("text").limit(60).collect() + odd.select("text").collect():
        if len(r.text or "") < 5000:
            assert quality_ledger.measure_text(r.text)[:5] == brute_measures(r.text)
    entries = quality_ledger.ledger(docs)
    kept = quality_ledger.apply_policy(entries)
    n_kept = kept.where("kept").count()
    table = quality_ledger.ablation(entries).where("policy = 'v1'").collect()
    assert len(table) == len(quality_ledger.RULES) and all(r.kept == n_kept <= r.kept_without_rule == r.kept + r.failed_only_by_rule for r in table)
    assert quality_ledger.apply_policy(quality_ledger.ledger(odd)).count() == len(ODD)
    assert quality_ledger.ledger(empty).count() == 0


# ---- 4 and 5


def test_language_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet")
    out = byte_cnn.op4_language_id(spark, sf).join(truth, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_of_odd_rows(spark, odd, empty):
    out = byte_cnn.identify(odd)
    assert out.count() == len(ODD) and out.where("lang_pred = 'und'").count() >= 2
    assert byte_cnn.identify(empty).count() == 0


def test_texts_without_a_letter_are_undetermined(spark):
    net = byte_cnn.train(["abc def", "ghi jkl"] * 4, ["en", "fr"] * 4, epochs=1)
    texts = ["½", "²", "Ⅷ", "12 ³", "", None, "\U0001f600", "a", "é½", "字"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in byte_cnn.predict(rows, net).collect()}
    assert all((got[i] == ("und", 0.0)) == (i < 7) for i in range(len(texts)))


def plain_probabilities(net, window):
    pooled = []
    for k, width in enumerate(byte_cnn.WIDTHS):
        for f in range(byte_cnn.FILTERS):
            weights = net.filters[k][f].reshape(width, byte_cnn.EMBED)
            responses = [sum(float(net.embed[window[i + j]] @ weights[j]) for j in range(width)) for i in range(len(window) - width + 1)]
            pooled.append(max(0.0, max(responses) + float(net.filter_bias[k][f])))
    z = np.array(pooled) @ net.dense + net.dense_bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_network_against_a_plain_convolution_and_its_gradients():
    texts, labels = ["the cat and a dog", "le chat et un chien", "der hund und die katze", "x" * 300], ["en", "fr", "de", "en"]
    net = byte_cnn.train(texts * 3, labels * 3, epochs=2)
    x = np.concatenate([byte_cnn.windows_of(t) for t in texts])
    got = byte_cnn.probabilities(net, x)
    for row, window in zip(got, x):
        assert row == pytest.approx(plain_probabilities(net, window), abs=1e-4)
    params = [net.embed, *net.filters, *net.filter_bias, net.dense, net.dense_bias]
    for p in params:
        p += np.random.default_rng(1).normal(0, 0.05, p.shape).astype(np.float32)
    part, y = x[:3], np.array([1, 2, 0])
    loss = lambda: -np.log(byte_cnn.probabilities(net, part)[np.arange(3), y].astype(np.float64)).mean()
    rng, checked = np.random.default_rng(0), 0
    for p, g in zip(params, byte_cnn._gradients(net, part, y)):
        for at in rng.choice(np.flatnonzero(np.abs(g.ravel()) > 1e-3) if (np.abs(g) > 1e-3).any() else [0], 4):
            old, step = p.ravel()[at], 2e-3
            p.ravel()[at] = old + step
            up = loss()
            p.ravel()[at] = old - step
            down = loss()
            p.ravel()[at] = old
            checked += abs((up - down) / (2 * step) - g.ravel()[at]) < 0.05 * abs(g.ravel()[at]) + 2e-3
    assert checked >= 0.9 * 4 * len(params)


def test_equal_probabilities_go_to_the_first_language():
    net = byte_cnn.train(["a", "b"], ["en", "de"], epochs=0)
    net.dense[:] = 0
    assert byte_cnn._predicted(net, ["word"]) == (["de"], [0.5])


def test_every_labelled_language_is_learned(spark):
    rows = [(i, "word " * 20 + chr(97 + i % 26), f"l{i // 2:03d}") for i in range(160)]
    _, labels = byte_cnn.labelled_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(labels)) == 80


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "scum": 4.0}, frozenset({"pond scum"}), middle=0.1)
    n = lambda t: toxicity.raw_score(lexicon, t)[1]
    assert n("an IDIOT, іdіоt and 1d10t idiotic i​diot") == 5 and n("pond scum") == 0 and n("the scum") == 1 and n("videoidiot") == 0 and n(None) == n("") == 0
    assert [n(t) for t in ("1diot", "5cum", "idio7", "an 1d10t5", "$cum!", "404 5cum 2024", "room 101 idiot h4t")] == [1] * 7
    assert toxicity.fold("2024 is 5 a.m. on 7th, c4t") == "2024 is 5 a.m. on tth, cat"
    far = toxicity.Lexicon({"scum": 4.0}, frozenset({f"{'p' * 60} scum"}), middle=0.1)
    assert toxicity.raw_score(far, "p" * 60 + " " * 90 + "scum")[1] == 0
    assert toxicity.score_of(lexicon, 0.0) < 0.5 < toxicity.score_of(lexicon, 1.0)


def test_automaton_against_a_plain_scan():
    rng = random.Random(4)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))): rng.random() for _ in range(30)}
    lexicon = toxicity.Lexicon(terms, frozenset({"ab cab", "c abc"}))
    for _ in range(200):
        text = "".join(rng.choice("abc ,") for _ in range(60))
        words = [(m.start(), m[0]) for m in re.finditer("[abc]+", text)]
        want = []
        for i, (_, word) in enumerate(words):
            found = [t for t in terms if word.startswith(t)]
            if found:
                near = [f"{words[i - 1][1]} {word}"] * (i > 0) + [f"{word} {words[i + 1][1]}" for _ in range(i + 1 < len(words))]
                want.append((word, terms[max(found, key=len)], near))
        assert list(toxicity.hits(lexicon, text)) == want


def test_a_fitted_lexicon_meets_odd_rows(spark, odd):
    rows = [(100 + i, f"quiet words number {i} stand here" if i % 2 else f"you dreadful slimeball number {i} stand there", "en", "s", 1) for i in range(60)]
    made = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([*rows, (999, "slimeball " * 40_000, "en", "s", 1)], SCHEMA))
    labels = spark.createDataFrame([(100 + i, 1 - i % 2) for i in range(60)] + [(100, 0), (None, 1), (101, None), (1, 0), (2, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(made, labels)
    got = {r.doc_id: r for r in toxicity.score(made, lexicon).collect() if r.doc_id is not None}
    assert lexicon.weights and all(got[100 + i].predicted == 1 - i % 2 for i in range(60)) and got[999].predicted == 1
    assert got[1].predicted == got[2].predicted == got[3].predicted == 0 and got[1].score == got[2].score


def test_toxicity_on_the_held_out_fold(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    got = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert got[(1, 1)] / (got[(1, 1)] + got.get((1, 0), 0)) > 0.9 and got.get((0, 1), 0) < 0.01 * got[(0, 0)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).where("predicted = 1").count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


# ---- 6


@pytest.mark.parametrize("frequent", [4, 1_000_000])
def test_scores_match_a_plain_model(spark, odd, empty, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rows = [(1, "the red cat saw the red dog"), (2, "a dog saw the cat"), (3, "the red cat"), (None, "red\n red"), (5, None), (2, ""), (6, "the red cat saw the red dog"), (7, "zyxwv saw")]
    labels = [(1, 1), (1, 0), (6, 1), (3, 0), (None, 1), (99, 1), (7, None)]
    path = token_store.default_tokenizer_path()
    enc = token_store.word_encoder(path)
    size = enc.size
    ids = [enc.encode([t])[0].tolist() for _, t in rows]
    grams = [list(zip([size, *x[:-1]], x)) for x in ids]
    good = [i in (1, 6) for i, _ in rows]

    def loss(seen, scale, h, w):
        words = [x for g in seen for _, x in g]
        near = [x for g in seen for y, x in g if y == h]
        one = (scale * words.count(w) + 1) / (scale * len(words) + size)
        return -np.log((scale * near.count(w) + lm_scoring.PRIOR * one) / (scale * len(near) + lm_scoring.PRIOR))

    n_target, n_all = sum(len(g) for g, t in zip(grams, good) if t), sum(map(len, grams))
    expected = []
    for k, (i, _) in enumerate(rows):
        rest = [g for j, g in enumerate(grams) if j != k]
        target = [g for j, g in enumerate(grams) if j != k and good[j]]
        means = [sum(loss(seen, scale, h, w) for h, w in grams[k]) / max(1, len(grams[k])) for seen, scale in ((target, 1), (rest, n_target / n_all), (rest, 1))]
        expected.append((i, len(grams[k]), means[0], means[1], means[0] - means[1], means[2]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] or 0, r[1], r[2])
    got = lm_scoring.cross_entropy_difference(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    for x, want in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert x[:2] == want[:2] and x[2:] == pytest.approx(want[2:], abs=1e-9)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = lm_scoring.cross_entropy_difference(odd, none).collect()
    assert len(got) == len(ODD) and all(r.difference == 0 for r in got)
    assert lm_scoring.cross_entropy_difference(empty, none).count() == 0


# ---- 7


def plain_matched(a, b):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def plain_similarity(a, b):
    n = plain_matched(a, b)
    return n / (len(a) + len(b) - n) if a or b else 1.0


def word_ids(words):
    return near_dedup.word_hashes(pa.array([" ".join(words)]))[0]


def test_near_duplicates_against_all_pairs(spark, docs, odd, empty):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(200)) for _ in range(20)]
    made = []
    for k, text in enumerate(base):
        for c in range(6):
            words = text.split()
            for _ in range(c):
                words[rng.randrange(len(words))] = f"w{rng.random()}"
            made.append((1000 + 10 * k + c, " ".join(words)))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    words = {r.doc_id: (r.text or "").lower().split() for r in df.collect()}
    counts = {i: Counter(w) for i, w in words.items()}
    home = {i: i for i in words}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n, m = len(words[a]), len(words[b])
            if min(n, m) >= 0.8 * max(n, m) and (counts[a] & counts[b]).total() >= 0.8 / 1.8 * (n + m) - 1e-9 and plain_similarity(words[a], words[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                home[y] = x
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in ids}
    out = near_dedup.near_duplicates(odd.select("doc_id", "text")).collect()
    assert len(out) == len(ODD) and sum(r.is_kept for r in out) == 4
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_first(odd).columns == odd.columns and near_dedup.keep_first(odd).count() == 4


@pytest.mark.parametrize("changed", [3, 6])
def test_planted_edits_are_linked(spark, changed):
    """60 words of which 3 are replaced (0.90 alike), and 120 of which 6 are inserted."""
    rng = random.Random(changed)
    rows = []
    for k in range(60):
        words = [f"v{rng.randrange(5000)}" for _ in range(20 * changed)]
        other = words[:]
        for at in rng.sample(range(len(words)), changed):
            other[at] = f"new{rng.random()}" + (f" {words[at]}" if changed == 6 else "")
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(60)) >= 57 and len(set(got.values())) >= 60


def test_shingles_and_keys_against_a_plain_version():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 40, 300, 5, 2)] + [None, "  x  y "]
    words, ends = near_dedup.word_hashes(pa.array(texts))
    found, cuts = near_dedup.elements(words, ends)
    keys = near_dedup.keys_of(found, cuts)
    seen = {}
    for i, text in enumerate(texts):
        split = (text or "").split()
        size = min(5, len(split))
        shingles = [tuple(split[j : j + size]) for j in range(len(split) - size + 1)] if split else []
        labelled = [(s, shingles[:j].count(s)) for j, s in enumerate(shingles)]
        mine = found[cuts[i] : cuts[i + 1]].tolist()
        assert len(mine) == len(labelled)
        for name, value in zip(labelled, mine):
            assert seen.setdefault(name, value) == value
        for f, odd in enumerate(near_dedup._ODD.tolist()):
            order = sorted(range(len(mine)), key=lambda j: -(mine[j] * odd % 2**64))[: near_dedup.MINIMA]
            key = np.full(1, odd, np.uint64)
            for j in sorted(order):
                key = near_dedup.chain(key, np.array(mine[j : j + 1], np.uint64))
            for _ in range(near_dedup.MINIMA - len(order)):
                key = near_dedup.chain(key, np.zeros(1, np.uint64))
            assert keys[i, f] == (key[0] if mine else 0)
    assert len(set(seen.values())) == len(seen)


def test_banded_alignment_against_the_plain_table():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))]
        b = a[:]
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b)) if b else 0
            b[at : at + rng.randrange(2)] = [rng.choice("abcdefgh")] * rng.randrange(2)
        got, want = near_dedup.edit_similarity(word_ids(a), word_ids(b)), plain_similarity(a, b)
        assert got == pytest.approx(want) if want >= 0.8 else got == 0.0


def test_a_cut_bucket_tells_the_same_pairs(spark, monkeypatch):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"f{i // 3}x{j}" for j in range(40)), *(f"o{rng.random()}" for _ in range(4))])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lambda: {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    whole = classes()
    monkeypatch.setattr(near_dedup, "ROWS_PER_BLOCK", 7)
    assert classes() == whole == {i: i // 3 * 3 for i in range(90)}


def test_rows_follow_a_groups_size_and_not_its_square(spark, monkeypatch):
    """80 long texts with a common passage, alike at 0.69, which bins don't tell from 0.8: no stored table has more rows than texts have keys, and the second round's links alone leave their tasks."""
    rng = random.Random(4)
    passage, count = [f"p{i}" for i in range(980)], 80
    texts = [passage + [f"o{rng.random()}" for _ in range(220)] for _ in range(count)]
    texts += [t[:1180] + [f"e{i}x{j}" for j in range(20)] for i, t in enumerate(texts[:5])]
    stored, write = Counter(), near_dedup.materialize

    def counted(df, label):
        table = write(df, label)
        stored[label] = max(stored[label], table.count())
        return table

    monkeypatch.setattr(near_dedup, "materialize", counted)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")).collect()}
    assert got == {i: i % count for i in range(count + 5)}
    assert max(stored.values()) <= near_dedup.SKETCHES * len(texts)


def test_components_against_a_plain_version(spark, monkeypatch):
    """A chain, a star whose centre is its largest node, a loop and random links; after the first round no table has all links again."""
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 140)] + [(i, 400) for i in range(300, 360)] + [(500, 500)] + [(1000 + rng.randrange(150), 1000 + rng.randrange(150)) for _ in range(100)]
    home = {i: i for pair in links for i in pair if pair[0] != pair[1]}
    for _ in home:
        for a, b in links:
            if a != b:
                home[a] = home[b] = min(home[a], home[b])
    read, write = [], near_dedup.materialize

    def counted(df, label):
        table = write(df, label)
        if label == "links":
            read.append(table.count())
        return table

    monkeypatch.setattr(near_dedup, "materialize", counted)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert {r.node: r.class_node for r in near_dedup.components(frame(links)).collect()} == home
    assert all(after < before / 2 for before, after in zip(read, read[1:])) and read[-1] == 0
    assert near_dedup.components(frame(links).where("false")).count() == 0


def test_alignment_is_order_sensitive():
    a = word_ids([f"w{i}" for i in range(100)])
    assert near_dedup.similarity(a, a) == near_dedup.edit_similarity(a, a) == 1.0
    for alike in (near_dedup.similarity, near_dedup.edit_similarity):
        assert alike(a, np.concatenate([a[48:], a[:48]])) < 0.8
        assert alike(a, a[:10]) == 0.0


# ---- 8


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for _ in range(100):
        codes = [rng.randrange(3) for _ in range(rng.randrange(1, 40))] + [-1]
        order, levels = html_main_text.suffix_array(np.array(codes))
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:])
        for i, n in enumerate(html_main_text.common_prefixes(order, levels)):
            x, y = codes[order[i] :], codes[order[i + 1] :]
            assert n == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_repeated_runs_against_all_substrings():
    rng = random.Random(3)
    for least in (2, 4):
        pages = [[[rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(rng.randrange(4))] for _ in range(6)]
        pages += [pages[0], pages[1]]
        names = [0, 1, 2, 3, 4, 5, 0, 7]  # the last is another page with the same stream
        seen = {}
        for name, page in zip(names, pages):
            for s in page:
                for i in range(len(s) - least + 1):
                    seen.setdefault(tuple(s[i : i + least]), set()).add(name)
        for page, got in zip(pages, html_main_text.repeated(pages, names, least)):
            want = [any(len(seen.get(tuple(s[i : i + least]), ())) >= 3 for i in range(max(0, j - least + 1), j + 1) if i + least <= len(s)) for s in page for j in range(len(s))]
            assert got.tolist() == want


def test_runs_decide_where_markup_is_taken_away(spark):
    """Pages whose host repeats its menu, advert and footer on three pages or more: without element and class names the text is the same, and without runs it isn't."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").toPandas()
    pages["html"] = pages["html"].str.replace(r"<!--.*?-->", "", regex=True)
    bare = lambda h: re.sub(r'<(/?)(nav|footer|article|ul|li)[^>]*>', r"<\1div>", re.sub(r"</?a\b[^>]*>", "", h)).replace(' class="ad"', "").replace("</div><div>", " ") if h else h
    pages["host"] = pages["url"].str.extract(html_main_text._HOST, expand=False).str.lower()
    pages["menu"] = pages["html"].str.extract(r"(<nav>.*?)<article>", flags=re.S, expand=False)
    pages["own"] = pages["html"].str.extract(r"<article>(.*?)</article>", flags=re.S, expand=False)
    pages = pages[(pages.groupby("own")["own"].transform("size") == 1) & pages["menu"].notna()]
    chosen = pages[pages.groupby(["host", "menu"])["own"].transform("size") >= 3].copy()
    whole = {r.page_id: r.text for r in html_main_text.extract(spark.createDataFrame(chosen[["page_id", "url", "html"]])).collect()}
    chosen["html"] = chosen["html"].map(bare)
    stripped = spark.createDataFrame(chosen[["page_id", "url", "html"]])
    squeeze = lambda t: "".join(t.split())
    got = {r.page_id: r.text for r in html_main_text.extract(stripped).collect()}
    free = [len(squeeze(got[i])) <= len(squeeze(whole[i])) + 60 for i in whole]
    kept = sum(sum((Counter(whole[i].split()) & Counter(got[i].split())).values()) for i in whole) / sum(len(t.split()) for t in whole.values())
    # passages that three pages' articles share are lost where nothing marks the article
    assert len(whole) > 300 and sum(free) >= 0.97 * len(whole) and kept > 0.9 and sum(squeeze(whole[i]) in squeeze(got[i]) for i in whole) > 0.7 * len(whole)
    apart = [html_main_text.main_text(html_main_text.blocks(h), np.zeros(10_000, bool)) for h in chosen["html"]]
    assert sum(len(a) > len(got[i]) for i, a in zip(chosen["page_id"], apart)) >= 0.9 * len(whole)


def test_names_that_only_hint_need_runs(spark):
    rows = [(1, "http://a.x/1", '<article><p class="social-policy">Body</p><div class="post-header"><h1>Title</h1></div><div class="comments">c</div></article><div class="ad-box">buy</div>')]
    rows += [(10 + i, "http://b.x", f'<article><p>own words of page {i}</p><div class="promo-box">take part in our great game and win a prize today</div></article>') for i in range(4)]
    rows += [(20, "http://c.x", '<div class="ad-box">take part in our great game and win a prize today</div><p>x</p>'), (21, None, None), (21, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("blocks", F.lit("b")).withColumn("host", F.lit("h"))
    out = {r.page_id: r.text for r in html_main_text.extract(pages).collect()}
    assert out[1] == "Body\n\nTitle" and all(out[10 + i] == f"own words of page {i}" for i in range(4))
    assert out[20] == "take part in our great game and win a prize today\n\nx" and out[21] == "" and html_main_text.extract(pages).count() == len(rows)


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad-box">buy</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>&nbsp; text<br>more<p>Two &lt;x&gt; &copy;</p><aside>side</aside><div class="comments"><p>reader</p></div><form>f</form></article><footer>end</footer>"""
    plain = "<body><div>Home News Sport Weather Travel Food Music Film Games</div><p>Only words of page {0} stand in here number {0}</p>"
    rows = [(1, "http://a.x/1", page), (2, None, None), (3, "http://b.x", ""), (4, "http://b.x/2", "<article>cut &am <p")] + [(10 + i, "http://c.x", plain.format(f"n{i}")) for i in range(5)]
    out = {r.page_id: r for r in html_main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Head & line\n\nOne bold text more\n\nTwo <x> ©" and out[1].n_chars == len(out[1].text)
    assert out[2].text == out[3].text == "" and out[4].text == "cut &am"
    assert out[12].text == "n2 stand in here number n2"  # a run goes on from the menu to the words that every page begins with
    assert html_main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- 9


def plain_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], {}
    for turn, i in enumerate(sorted(range(len(lengths)), key=lambda i: -lengths[i])):
        fit = [b for b in bins if b["left"] >= lengths[i] and b["sources"].count(sources[i]) < 2 and (clusters[i] < 0 or clusters[i] not in b["clusters"])]
        if not fit:
            bins.append({"number": len(bins), "left": capacity, "sources": [], "clusters": set()})
        b = min(fit, key=lambda b: (b["left"], -b["turn"])) if fit else bins[-1]
        b["left"] -= lengths[i]
        b["turn"] = turn
        b["sources"].append(sources[i])
        b["clusters"].add(clusters[i])
        out[i] = b["number"]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    lengths, sources, clusters = rng.integers(1, 60, 300), rng.integers(0, 2 + 3 * seed, 300), rng.integers(-1, 40, 300)
    home = packing.best_fit(lengths, sources, clusters, 100)
    assert home.tolist() == plain_best_fit(lengths.tolist(), sources.tolist(), clusters.tolist(), 100)


def test_equal_rows_spread_over_shards(spark):
    items = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(700).cast("long").alias("n_tokens"), F.pmod("id", F.lit(30)).cast("string").alias("source"))
    out = packing.pack(items)
    sizes = [r["count"] for r in out.groupBy(F.split("bin_id", "-")[0].alias("shard")).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 6000 and out.groupBy("bin_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_every_token_is_packed_once(spark, docs, odd, empty):
    for df in (docs, odd):
        items = packing.with_lengths(df)
        out = packing.pack(items, capacity=256)
        assert out.agg(F.sum("length")).first()[0] == items.agg(F.sum("n_tokens")).first()[0]
        assert out.groupBy("bin_id").agg(F.sum("length").alias("n")).where("n > 256").count() == 0
    assert packing.pack(packing.with_lengths(empty)).count() == 0


# ---- 10


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 12_288, 12_289, 50_000])
def test_streams_give_back_the_payload(size):
    payload, n = transport_stream.payload_of("é" * (size // 2) + "a" * (size % 2))
    stream = transport_stream.mux(payload)
    got = transport_stream.demux(stream)
    assert got.payload == payload and n == size and len(payload) % 192 == 0 and len(stream) % 188 == 0
    assert got.times == got.clocks == [90_000 + k * 64 * 360 for k in range(-(-len(payload) // 12_288))]
    for at in (0, 10, 188 * (len(stream) // 188 - 1)):
        broken = bytearray(stream)
        broken[at] ^= 0xFF
        with pytest.raises(ValueError):
            transport_stream.demux(bytes(broken))
    if len(stream) > 188 * 5:
        with pytest.raises(ValueError):
            transport_stream.demux(stream[: 188 * 3] + stream[188 * 4 :])


def _pes(data, head=b"\x80\x00\x00", size=True):
    body = head + data
    return b"\0\0\1\xbd" + (len(body) if size else 0).to_bytes(2, "big") + body


def _packets(pid, data, counter=0, first_flags=None):
    """Packets of one elementary packet, without clock."""
    out = []
    while data:
        field = b"" if first_flags is None or out else bytes([1, first_flags])
        room = 184 - len(field)
        part, data = data[:room], data[room:]
        if len(part) < room:
            short = room - len(part)
            field = bytes([len(field) - 1 + short if field else short - 1]) + (field[1:] + b"\xff" * short if field else b"\0" * (short > 1) + b"\xff" * (short - 2))
        out.append(bytes([0x47, (0 if out else 0x40) | pid >> 8, pid & 255, (0x30 if field else 0x10) | counter % 16]) + field + part)
        counter += 1
    return out


def test_legal_streams_of_other_writers():
    import struct

    ts = transport_stream
    pat = ts.section_packets(0, 0, 1, struct.pack(">HHHH", 1, 0xE100, 2, 0xE300))
    info = b"\x05\xf0" + bytes(240)  # a descriptor that makes the table longer than a packet
    one = ts.section_packets(0x100, 2, 1, struct.pack(">HH", 0xE101, 0xF000 | len(info)) + info + struct.pack(">BHHBHH", 6, 0xE101, 0xF000, 0x0F, 0xE102, 0xF000))
    two = ts.section_packets(0x300, 2, 2, struct.pack(">HHBHH", 0xE301, 0xF000, 0x1B, 0xE301, 0xF000))
    assert len(one) == 376
    open_, last = _packets(0x101, _pes(b"a" * 500, size=False)), _packets(0x101, _pes(b"b" * 300), 3)
    other = _packets(0x102, _pes(b"other"))
    empty_packet = bytes([0x47, 1, 1, 0x20 | 2, 183, 0]) + b"\xff" * 182
    stream = pat + one + two + b"".join([*open_[:2], open_[1], *other, open_[2], empty_packet, *last])
    got = ts.demux(stream)
    assert got.payload == b"a" * 500 + b"b" * 300 and got.times == got.clocks == [] and got.programs == {1: {0x101: 6, 0x102: 15}, 2: {0x301: 27}}
    assert ts.demux(stream, 0x102).payload == b"other"
    jump = _packets(0x101, _pes(b"b" * 300), 9, first_flags=0x80)
    assert ts.demux(pat + one + two + b"".join([*open_, *jump])).payload == got.payload
    for broken in ([*open_, *_packets(0x101, _pes(b"b" * 300), 9)], [*open_[:2], open_[1], open_[1], open_[2]], open_[1:], [*open_, last[0]]):
        with pytest.raises(ValueError):
            ts.demux(pat + one + two + b"".join(broken))
    with pytest.raises(ValueError):
        ts.demux(stream, 0x999)


def test_a_bad_stream_is_a_row_with_its_reason(spark):
    good = transport_stream.mux(transport_stream.payload_of("text")[0])
    rows = [(1, 4, good), (2, 4, good[:100]), (3, 4, None), (4, 4, good[:188]), (5, 4, b"\0" * 188), (6, 4, good)]
    out = {r.doc_id: r for r in transport_stream.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert [out[i].status == "ok" for i in range(1, 7)] == [True, False, False, False, False, True]
    assert out[1].payload_bytes == 192 and all(out[i].payload_bytes is None and out[i].feature is None for i in (2, 3, 4, 5)) and out[2].media_bytes == 100 and out[3].media_bytes is None


def test_media_of_odd_rows(odd, empty):
    out = transport_stream.read_media(transport_stream.encode_media(odd)).collect()
    assert len(out) == len(ODD) and len({r.media_sha256 for r in out if r.doc_id in (4, 5)}) == 1
    assert transport_stream.read_media(transport_stream.encode_media(empty)).count() == 0


# ---- pipeline


def test_pipeline_stages_against_plain_versions(spark, odd):
    """Each stage on all that the one before kept, with odd rows and clashing extra columns in the input."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.DOCUMENT_COLUMNS)
    bad = odd.where("doc_id IS NULL OR doc_id <> 3").select(F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars")
    docs = start.unionByName(bad).withColumn("score", F.lit(1)).withColumn("row", F.lit("r")).withColumn("node", F.lit(b"n"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    held_out = byte_cnn.fold_of("doc_id", 3) == 1
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs.collect()
        after = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        if name == "toxicity":
            lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = [r for r in before if toxicity.score_of(lexicon, toxicity.raw_score(lexicon, r.text)[0]) < 0.5]
        elif name == "language_id":
            net, least = byte_cnn.fit_known(docs.where(~held_out), docs.where(held_out))
            langs, scores = byte_cnn._predicted(net, [r.text for r in before])
            want = [r for r, lang, s in zip(before, langs, scores) if lang != "und" and s >= least - 1e-6]
        else:
            words = [(r.text or "").lower().split() for r in before]
            home = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    n, m = len(words[i]), len(words[j])
                    if min(n, m) >= 0.8 * max(n, m) and (Counter(words[i]) & Counter(words[j])).total() >= 0.8 / 1.8 * (n + m) - 1e-9 and home[i] != home[j] and plain_similarity(words[i], words[j]) >= 0.8:
                        old, new = home[i], home[j]
                        home = [new if h == old else h for h in home]
            want = [min((r for r, h in zip(before, home) if h == c), key=key) for c in set(home)]
        assert after.columns == list(corpus_pipeline.DOCUMENT_COLUMNS) and 0 < after.count() <= len(before)
        assert [key(r) for r in sorted(after.collect(), key=key)] == [key(r) for r in sorted(want, key=key)], name
        docs = after
    packed = corpus_pipeline.pack_documents(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    encoder = token_store.word_encoder(token_store.default_tokenizer_path()).tokenizer
    assert packed.agg(F.sum("length")).first()[0] == sum(len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    none = start.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_counted_ids_and_words_against_the_library_and_word_hashes(monkeypatch):
    """Of odd texts, whatever has been forgotten."""
    rng = random.Random(9)
    signs = ["a", "B", "é", "É", "ß", "İ", "ǅ", "中", "ﬁ", "e\u0301", "\u0301", "1", "23", "'s", ".", ",", "<|endoftext|>", "</w>", " ", "  ", "\n", "\t", "\r", "\u00a0", "\u3000", "\x1c", "\x85", "🙂"]
    texts = [None, "", " ", "\n\n", "x\ty z"] + ["".join(rng.choice(signs if i % 2 else signs[:20] + [" ", "\n"]) for _ in range(rng.randrange(60))) for i in range(600)]
    encoder = token_store.WordEncoder(token_store.default_tokenizer_path())
    want = [len(ids) for ids in encoder._library([t or "" for t in texts])]
    words, ends = near_dedup.word_hashes(pa.array(texts))
    for chunks, pretokens in ((800_000, 600_000), (200, 100)):
        monkeypatch.setattr(token_store, "COUNTED_CHUNKS", chunks)
        monkeypatch.setattr(token_store, "COUNTED_PRETOKENS", pretokens)
        counter = token_store.WordCounter(encoder)
        for _ in range(2):
            for at in range(0, len(texts), 50):
                sizes, found, cuts = counter.count(pa.array(texts[at : at + 50], pa.string()))
                assert sizes.tolist() == want[at : at + 50]
                assert found.tolist() == words[ends[at] : ends[min(at + 50, len(texts))]].tolist() and (cuts == ends[at : at + 51] - ends[at]).all()
    encoder.by_words = False
    sizes, found, cuts = counter.count(pa.array(texts))
    assert sizes.tolist() == want and (found == words).all() and (cuts == ends).all()


def test_ids_of_new_words_are_counted_without_the_slow_library(monkeypatch):
    """Many unlike words cost no call of the tokenizers library, and number as many ids as it says."""
    rng = random.Random(5)
    encoder = token_store.WordEncoder(token_store.default_tokenizer_path())
    entries = [t.removesuffix("</w>") for t in encoder.tokenizer.get_vocab(False) if t.isascii()]
    words = ["".join(rng.choices(entries, k=rng.randrange(1, 5))) for _ in range(20_000)] + ["a" * n for n in (99, 100, 499, 500, 501, 3_000)] + ["élan" * 200, "don't''ll", "!'s", "x\r", "1²\u00a0½", "É\x85é"]
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    counter, library = token_store.WordCounter(encoder), encoder._library
    want = [len(ids) for ids in library(texts)]
    called = []
    monkeypatch.setattr(encoder, "_library", lambda pieces: called.extend(pieces) or library(pieces))
    assert counter.count(pa.array(texts))[0].tolist() == want
    assert not called


def test_counted_entries_are_given_themselves(tmp_path):
    """What makes ids by lowest neighbours equal to ids by merges: the file's merges give every entry itself. A file with other merges is left to its own library."""
    import json

    path = token_store.default_tokenizer_path()
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in said["model"]["merges"]]
    rank = {m: i for i, m in enumerate(merges)}
    for entry in said["model"]["vocab"]:
        symbols = [*entry[:-5], entry[-5:]] if entry.endswith("</w>") else list(entry)
        while len(symbols) > 1:
            at = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), len(rank)))
            assert (symbols[at], symbols[at + 1]) in rank, entry
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    ranks = token_store._ranks(path)
    assert sorted(ranks.values()) == list(range(len(said["model"]["vocab"])))
    said["model"]["merges"][:2] = said["model"]["merges"][1::-1]
    (tmp_path / "other.json").write_text(json.dumps(said))
    assert token_store._ranks(str(tmp_path / "other.json")) is None
    texts = ["in the thin inn", None, ""]
    other = token_store.WordEncoder(str(tmp_path / "other.json"))
    assert token_store.WordCounter(other).count(pa.array(texts))[0].tolist() == [len(ids) for ids in other._library([t or "" for t in texts])]


def test_bins_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 700, 9_000, 90_000):
        whole = rng.integers(0, 2**63, size, dtype=np.int64).view(np.uint64)
        whole[: size // 2] = whole[0]  # a word that fills its bin
        for share in (0.0, 0.05, 0.1, 0.2, 0.5):
            other = whole.copy()
            changed = rng.random(size) < share
            other[changed] = rng.integers(0, 2**63, int(changed.sum()), dtype=np.int64).view(np.uint64)
            a, b = (near_dedup.bins_of(x, np.array([0, size])) for x in (whole, other))
            verdict = near_dedup.may_reach(a, b, np.array([size]), np.array([size]))[0]
            if 1 - changed.mean() >= 0.8 / 0.9 * 1.02:
                assert verdict
            if 60 <= size <= 700 and share == 0.5:
                assert not verdict


def test_large_hosts_deal_alike_by_broadcast_and_by_salt(spark):
    rows = [(i, f"https://{'big' if i % 3 else 'small' + str(i)}.test/{i}", f"<p>page {i}</p>") for i in range(900)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html_main_text._host())
    large = spark.createDataFrame([("big.test", 3)], "host string, groups long")
    sets = [sorted((r.page_id or -1, r.host, r.part) for r in html_main_text.deal(pages, large, most).collect()) for most in (10, 0)]
    assert sets[0] == sets[1] and len(sets[0]) == 901
    assert {p for _, h, p in sets[0] if h == "big.test"} == {0, 1, 2} and {p for _, h, p in sets[0] if h != "big.test"} == {0}


def test_equal_pages_are_split(spark):
    notice = "this site will be closed for work on sunday night"
    rows = [(1, "http://a.x/1", f"<div>{notice}</div><p>the same page</p>")] * 100 + [(2 + i, "http://a.x/1", f"<div>{notice}</div><p>n{i} alone</p>") for i in range(3)]
    out = html_main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 8).collect()
    assert len(out) == 103 and {r.text for r in out if r.page_id == 1} == {"the same page"} and {r.text for r in out if r.page_id == 3} == {"n1 alone"}


def test_runs_of_a_host_decide_on_every_page_whatever_the_deal(spark):
    notice = "this site will be closed for work on sunday night"
    rows = []
    for i in range(90):
        own = " ".join(f"p{i}w{j}" for j in range(12))
        shown = f"<div>{notice}</div>" if i % 30 == 0 else ""
        rows.append((i, "http://a.x/1", f"<body>{shown}<p>{own}</p></body>" if i % 60 else f"<body>{shown}<p>{own}</p><article>main {i}</article></body>"))
    rows += [(100 + i, "http://b.x/1", f"<article>{notice} once more x{i}</article>") for i in range(4)] + [(200, "http://b.x/1", f"<p>{notice} once more</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (256, 8):
        out = {r.page_id: r.text for r in html_main_text.extract(pages, size).collect()}
        for i in range(90):
            own = " ".join(f"p{i}w{j}" for j in range(12))
            assert out[i] == (own if i % 60 else f"{own}\n\nmain {i}")
        assert all(out[100 + i] == f"{notice} once more x{i}" for i in range(4)) and out[200] == f"{notice} once more"


@pytest.mark.parametrize("languages", [("de", "en", "es", "fr"), ("en", "fr")])
def test_language_stage_rejects_foreign_and_garbled_documents(spark, languages):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isin(*languages))
    rng = random.Random(4)
    russian, polish = "это было очень давно когда люди жили в лесу и не знали огня".split(), "byłem wczoraj bardzo zmęczony ponieważ pracowałem przez cały dzień w ogrodzie".split()
    planted = [" ".join(rng.choice(words) for _ in range(60)) for words in (russian, polish) for _ in range(20)]
    planted += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500)) for _ in range(20)] + ["12 34 !", "", None]
    bad = spark.createDataFrame([(10**6 + i, t, None, "s", 1) for i, t in enumerate(planted)], SCHEMA)
    mixed = docs.select(*corpus_pipeline.DOCUMENT_COLUMNS).unionByName(bad)
    got = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, mixed, "").select("doc_id").collect()}
    clean = [r.doc_id for r in docs.where("length(text) > 100").collect()]
    assert not any(i >= 10**6 for i in got) and sum(i in got for i in clean) > 0.97 * len(clean)
    held_out = byte_cnn.fold_of("doc_id", 3) == 1
    net, least = byte_cnn.fit_known(mixed.where(~held_out), mixed.where(held_out))
    plain = set()
    for r in mixed.collect():
        if not any(c.isalpha() for c in r.text or ""):
            continue
        x = byte_cnn.windows_of(r.text)
        p = np.average(byte_cnn.probabilities(net, x), axis=0, weights=(x != 0).sum(axis=1))
        if net.languages[int(p.argmax())] != "und" and p.max() >= least:
            plain.add(r.doc_id)
    assert len(got ^ plain) <= 1


def test_near_copies_are_apart_and_lengths_are_tokens(spark, odd):
    words = [f"w{i}" for i in range(100)]
    near = [(i, " ".join([*words[:50], f"x{i}", *words[51:]]), "en", f"s{i}", 1) for i in range(5)]
    df = spark.createDataFrame([*near, (9, "汉字" * 300, "zh", "s", 1), (10, "汉字" * 300, "zh", "t", 1)], SCHEMA)
    items = packing.with_classes(df).collect()
    assert len({r.cluster for r in items if r.doc_id < 5}) == 1 and len({r.cluster for r in items if r.doc_id >= 9}) == 1 and len({r.cluster for r in items}) == 2 and all(r.source for r in items)
    encoder = token_store.word_encoder(token_store.default_tokenizer_path()).tokenizer
    assert {r.doc_id: r.n_tokens for r in items} == {r.doc_id: len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in df.collect()}
    bins = packing.pack(packing.with_classes(df)).where("doc_id < 5").collect()
    assert len({r.bin_id for r in bins}) == 5
    assert packing.with_classes(odd).count() == len(ODD)
