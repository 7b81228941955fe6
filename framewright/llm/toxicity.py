"""Operator 5: toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, invisible characters, and in each word that has a letter the digits and signs that stand for letters, wherever they are) and searched by an Aho-Corasick automaton for lexicon terms. A term is a word
beginning: it counts where it starts a word. Terms weigh their log odds; the sum is divided by the square root of the text's length. Hits inside an
exception phrase (a neighbouring word that makes the word harmless) don't count. A logistic curve turns the sum into a score.

The lexicon, the exceptions and the curve are learned from a bounded sample of labelled rows (``sample_per_class``), drawn by a hash of the id; the sample bounds the terms, nothing else does.

Null and empty texts have no hits and get the score of such texts. Null labels and ids teach nothing; a row labelled twice counts as toxic if any label is. Without
toxic labels there is no lexicon and all scores are low. Repeated rows give repeated results; exact copies teach once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import documents, fold_of, map_text

SAMPLE_PER_CLASS = 3000
SHORTEST, LONGEST = 4, 12
LEAST_WEIGHT = 3.0
LEAST_PRECISION = 0.9
#: A term is in so many toxic texts of the sample at least, and in such a share of them.
LEAST_TEXTS, LEAST_SHARE = 3, 0.01
SEED = 11

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁһԛԝοαεικνρτυχ", "abekmhopctyxijsdhqwoaeikvptux")
STAND_INS = "01345789@$"
DIGITS = str.maketrans(STAND_INS, "oieastbgas")
_LOOKALIKE = re.compile("[Ͱ-ϿЀ-ԯ]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
#: Runs of letters and stand-ins for letters that have a stand-in.
_LEET = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[01345789@$](?:[^\W\d_]|[01345789@$])*+")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text).lower()
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _LOOKALIKE.search(text):
            text = text.translate(HOMOGLYPHS)
    return _LEET.sub(_letters, text) if any(c in text for c in STAND_INS) else text


def _letters(run: re.Match) -> str:
    """The run with letters for digits, if it has a letter of its own."""
    return run[0].translate(DIGITS) if _WORD.search(run[0]) else run[0]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    middle: float = 1.0  # the sum that gives 0.5
    slope: float = 6.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None and self.weights:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(term, (len(term), weight))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}


def hits(lexicon: Lexicon, folded: str):
    """(start, end, weight, phrases) of each counted word: the longest term of a word counts once."""
    automaton = lexicon.automaton()
    if automaton is None or not folded:
        return
    best: dict[int, tuple[int, float]] = {}
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if start and folded[start - 1].isalpha():
            continue
        if start not in best or size > best[start][0]:
            best[start] = (size, weight)
    for start, (size, weight) in sorted(best.items()):
        end = start + size
        while end < len(folded) and folded[end].isalpha():
            end += 1
        last = start
        while last and not folded[last - 1].isalpha():
            last -= 1
        first = last
        while first and folded[first - 1].isalpha():
            first -= 1
        word, after = folded[start:end], _WORD.search(folded, end)
        yield word, weight, ([f"{folded[first:last]} {word}"] if last else []) + ([f"{word} {after[0]}"] if after else [])


def raw_score(lexicon: Lexicon, text: str | None) -> tuple[float, int]:
    folded = fold(text)
    total, n = 0.0, 0
    for _, weight, phrases in hits(lexicon, folded):
        if not any(p in lexicon.exceptions for p in phrases):
            total, n = total + weight, n + 1
    return total / math.sqrt(100 + len(folded)), n


def score_of(lexicon: Lexicon, raw: float) -> float:
    return 1 / (1 + math.exp(max(-60.0, min(60.0, lexicon.slope * (1 - raw / lexicon.middle)))))


def _labelled(df: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, toxic of the sample. Its ids are at most about 2 * per_class rows, small enough to broadcast at any size of input."""
    clean = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold_of("doc_id", 5) != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in clean.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, counts.get(0, 0)))))
    wanted = clean.where(share < rate)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").where("text IS NOT NULL")


def fit(df: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Lexicon:
    """Learn terms, weights, exceptions and the curve from labelled rows of four of five folds."""
    sample = _labelled(df, labels, per_class)
    # exact copies teach once: one row of each text
    rows = sample.groupBy(F.sha2("text", 256).alias("same")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    rows = rows.select("toxic", "text").persist()
    try:
        totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if not toxic:
            return Lexicon({})
        least = max(LEAST_TEXTS, LEAST_SHARE * toxic)

        def starts(labels_, texts):
            seen: Counter = Counter()
            for label, text in zip(labels_, texts):
                found = {w[:size] for w in set(_WORD.findall(fold(text))) for size in range(SHORTEST, min(LONGEST, len(w)) + 1)}
                seen.update((label, t) for t in found)
            return {"toxic": [k[0] for k in seen], "term": [k[1] for k in seen], "n": list(seen.values())}

        counted = map_text(rows, starts, "toxic long, term string, n long", id_column="toxic", rows=500).groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
        weight = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
        # as shares of their classes, so that the classes' sizes don't matter
        precise = (F.col("bad") / float(toxic)) >= LEAST_PRECISION * (F.col("bad") / float(toxic) + F.col("good") / float(max(1, clean)))
        found = counted.where(F.col("bad") >= least).withColumn("weight", weight).where(precise & (F.col("weight") >= LEAST_WEIGHT)).collect()
        lexicon = Lexicon(_shortest({r["term"]: r["weight"] for r in found}))

        def looked(labels_, texts):
            phrases: Counter = Counter()
            for label, text in zip(labels_, texts):
                phrases.update({(label, p) for _, _, ps in hits(lexicon, fold(text)) for p in ps})
            return {"toxic": [k[0] for k in phrases], "phrase": [k[1] for k in phrases], "n": list(phrases.values())}

        phrases = map_text(rows, looked, "toxic long, phrase string, n long", id_column="toxic", rows=500).groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
        harmless = phrases.where((F.col("good") >= LEAST_TEXTS) & (F.col("good") >= 9 * F.col("bad"))).collect()
        lexicon = Lexicon(lexicon.weights, frozenset(r["phrase"] for r in harmless))

        def summed(labels_, texts):
            return {"toxic": labels_, "raw": [raw_score(lexicon, t)[0] for t in texts]}

        raws = sorted((r["raw"], r["toxic"]) for r in map_text(rows, summed, "toxic long, raw double", id_column="toxic").collect())
    finally:
        rows.unpersist()
    lexicon.middle = _middle(raws)
    return lexicon


def _shortest(weights: dict[str, float]) -> dict[str, float]:
    """Drop terms that a shorter kept term starts: it finds the same words and more."""
    kept: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t), t)):
        if not any(term[:size] in kept for size in range(SHORTEST, len(term))):
            kept[term] = weights[term]
    return kept


def _middle(raws: list[tuple[float, int]]) -> float:
    """The cut with the fewest weighted errors (both classes count alike), half-way between its neighbours and above 0."""
    bad, good = max(1, sum(y for _, y in raws)), max(1, sum(1 - y for _, y in raws))
    values = sorted({r for r, _ in raws})
    at, wrong, best, cut = 0, good / good, 2.0, 1.0
    for i, value in enumerate(values):
        while at < len(raws) and raws[at][0] <= value:
            wrong += 1 / bad if raws[at][1] else -1 / good
            at += 1
        if wrong < best - 1e-12:
            best, cut = wrong, (value + values[i + 1]) / 2 if i + 1 < len(values) else value + 1.0
    return max(cut, 1e-6)


def score(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, n_hits of every row's whole text."""

    def run(ids, texts):
        raw = [raw_score(lexicon, t) for t in texts]
        scores = [score_of(lexicon, r) for r, _ in raw]
        return {"doc_id": ids, "score": scores, "predicted": [int(s >= 0.5) for s in scores], "n_hits": [n for _, n in raw]}

    return map_text(df, run, "doc_id long, score double, predicted int, n_hits long")


def keep_clean(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows and columns of df without those that are predicted toxic."""

    @F.pandas_udf("boolean")
    def toxic(texts):
        return texts.map(lambda t: score_of(lexicon, raw_score(lexicon, t)[0]) >= 0.5)

    return df.where(~toxic(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon).select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")
