"""Operator 6: cross-entropy difference of two matched n-gram models.

Tokens are operator 2's ids, so both models share one vocabulary and no text has unknown tokens. Both are bigram models with the same smoothing (``PRIOR`` tokens of the unigram model, which
has one token more of each kind); the target model is counted over the target rows, the background model over all rows. The background's counts are scaled to the target's number of tokens, so that
sizes don't tell the models apart. A row's own tokens are taken out of every count before it is scored, so no row is scored by a model that saw it. A document's score is the mean over its
tokens of target loss minus background loss: the lower, the more it reads like the target. ``corpus_loss`` is the loss under all rows' counts without scaling.

Counts cover every row and every token and stay a table that grows with the corpus: each task sends its bigrams' sums. Totals of tokens and contexts are bounded by the vocabulary and go to every
task; so do the bigrams that are at least one in ``FREQUENT`` of all, so at most ``FREQUENT`` of them (24 bytes each). What a document has of other bigrams joins the table by bigram; one that occurs once only is unseen once its
row is taken out, and is left out of the join.

Null and empty texts have no tokens and score 0. Null ids are kept and are never targets; repeated rows count as often as they occur; a row labelled more than once is good if any label says so. Without target rows both
models are the background and all differences are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import token_store
from framewright.llm.common import MOST_BROADCAST, documents, materialize

PRIOR = 5.0
CHUNK = 1 << 20
FREQUENT = 4_000_000
LOSSES = ("target_loss", "background_loss", "corpus_loss")


def coded(df: DataFrame, labels: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (operator 2's, as bytes), is_target (a label calls the row good). Ids are joined, never texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in token_store.encoded(batches, 1, tokenizer_path):
            data, width = ids.tobytes(), ids.dtype.itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[s:e] for s, e in zip((ends[:-1] * width).tolist(), (ends[1:] * width).tolist())], pa.binary())], names=["doc_id", "ids"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good_id")).distinct().withColumn("good_salt", F.lit(0))
    # null ids are dealt by their ids' bytes instead of meeting in one task
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.hash("ids")).otherwise(0))
    side = F.broadcast(good) if good.count() <= MOST_BROADCAST else good.hint("merge")
    return rows.join(side, (F.col("doc_id") == F.col("good_id")) & (F.col("salt") == F.col("good_salt")), "left").select("doc_id", "ids", F.col("good_id").isNotNull().alias("is_target"))


def _bigrams(packed: list[bytes | None], dtype: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context of each token (``size`` at a text's start), the token, and the number of tokens of each text."""
    counts = np.array([len(p) // np.dtype(dtype).itemsize if p else 0 for p in packed], np.int64)
    word = np.frombuffer(b"".join(p for p in packed if p), dtype).astype(np.int64)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = size
    return before, word, counts


def count_bigrams(rows: DataFrame, dtype: str, size: int) -> DataFrame:
    """key (context * (size + 1) + token), background, target: how often each bigram occurs in all rows and in rows with is_target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def send():
            key, place, n = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True, return_counts=True)
            of_target = np.bincount(place, np.concatenate([w[1] for w in waiting]), len(key)).astype(np.int64)
            for at in range(0, len(key), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(n[part]), pa.array(of_target[part])], names=["key", "background", "target"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                before, word, counts = _bigrams(batch.column(0).to_pylist(), dtype, size)
                waiting.append((before * (size + 1) + word, np.repeat(batch.column(1).to_numpy(zero_copy_only=False), counts)))
                held += len(word)
                if held > CHUNK:
                    yield from send()
                    waiting.clear()
                    held = 0
        if held:
            yield from send()

    partial = rows.select("ids", "is_target").mapInArrow(run, "key long, background long, target long")
    return partial.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


@dataclass
class Models:
    """What every task gets: totals of tokens and contexts (background, target), bounded by the vocabulary, and the frequent bigrams."""

    size: int
    dtype: str
    words: np.ndarray  # 2 x size
    contexts: np.ndarray  # 2 x (size + 1)
    keys: np.ndarray  # ascending
    counts: np.ndarray  # 2 x keys

    def losses(self, key: np.ndarray, counts: np.ndarray, own: np.ndarray, own_context: np.ndarray, own_word: np.ndarray, own_total: np.ndarray, is_target: np.ndarray) -> list[np.ndarray]:
        """LOSSES of bigrams in documents. counts: 2 x bigrams, of all rows; own: of the document, which are taken out."""
        before, word = key // (self.size + 1), key % (self.size + 1)
        totals = self.words.sum(axis=1)
        has_target = totals[1] > 0
        out = []
        for model, scale in ((1, 1.0), (0, totals[1] / max(1, totals[0])), (0, 1.0)) if has_target else ((0, 1.0),) * 3:
            out_of = is_target if model else np.ones(len(key), bool)  # the target's counts hold the row only if it is one

            def less(n, mine, scale=scale, out_of=out_of):
                return scale * np.maximum(n - mine * out_of, 0)

            one = (less(self.words[model][word], own_word) + 1) / (less(totals[model], own_total) + self.size)
            out.append(-np.log((less(counts[model], own) + PRIOR * one) / (less(self.contexts[model][before], own_context) + PRIOR)))
        return out


def models(counts: DataFrame, dtype: str, size: int) -> tuple[Models, int]:
    """The models' shared part, and the least count of a frequent bigram. counts: a stored table."""

    def totals(part, n: int) -> np.ndarray:
        found = counts.groupBy(part.alias("id")).agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
        out = np.zeros((2, n), np.int64)
        for row, name in zip(out, ("background", "target")):
            row[found["id"].to_numpy()] = found[name].to_numpy()
        return out

    words, contexts = totals(F.col("key") % (size + 1), size), totals(F.floor(F.col("key") / (size + 1)), size + 1)
    least = max(2, -(-int(words[0].sum()) // FREQUENT))
    frequent = counts.where(F.col("background") >= least).toArrow().sort_by("key")
    return Models(size, dtype, words, contexts, frequent["key"].to_numpy(), np.stack([frequent[c].to_numpy() for c in ("background", "target")])), least


def _counted(group: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """How often each item occurs in its group."""
    _, place, n = np.unique(group * width + inside, return_inverse=True, return_counts=True)
    return n[place]


def score(rows: DataFrame, counts: DataFrame, dtype: str, size: int) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference, corpus_loss (means over tokens) of every row. rows and counts: stored tables."""
    shared, least = models(counts, dtype, size)
    shared = rows.sparkSession.sparkContext.broadcast(shared)
    names = ["row", "key", "doc_id", "n", "own_context", "own_word", "is_target", "n_tokens", *LOSSES]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "long", "long", "long", "long", "long", "boolean", "long", "double", "double", "double")))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A line for each row with the sums of its frequent bigrams, under a key that no bigram has, and one for each other bigram of the row."""
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                before, word, tokens = _bigrams(batch.column(2).to_pylist(), m.dtype, m.size)
                target = batch.column(3).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(tokens)), tokens)
                key, base = before * (m.size + 1) + word, (m.size + 1) ** 2
                _, first, n = np.unique(text * base + key, return_index=True, return_counts=True)
                own_context, own_word = _counted(text, before, m.size + 1)[first], _counted(text, word, m.size + 1)[first]
                text, key = text[first], key[first]
                place = np.minimum(np.searchsorted(m.keys, key), max(len(m.keys) - 1, 0))
                common = m.keys[place] == key if len(m.keys) else np.zeros(len(key), bool)
                c = np.flatnonzero(common)
                losses = m.losses(key[c], m.counts[:, place[c]], n[c], own_context[c], own_word[c], tokens[text[c]], target[text[c]])
                sums = [np.bincount(text[c], x * n[c], len(tokens)) for x in losses]
                rest = np.flatnonzero(~common)
                row = batch.column(0).to_numpy()
                none = np.zeros(len(tokens), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([row, -1 - row, batch.column(1), none, none, none, target, tokens, *sums], kinds)], names=names)
                if len(rest):
                    of = text[rest]
                    more = [row[of], key[rest], pa.nulls(len(rest), pa.int64()), n[rest], own_context[rest], own_word[rest], target[of], tokens[of], *[np.zeros(len(rest))] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(more, kinds)], names=names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            key, n, own_context, own_word, tokens, background, target = (batch.column(i).to_numpy() for i in (1, 3, 4, 5, 7, 11, 12))
            bigram = np.flatnonzero(key >= 0)
            sums = [batch.column(i).to_numpy().copy() for i in (8, 9, 10)]
            found = m.losses(key[bigram], np.stack([background, target])[:, bigram], n[bigram], own_context[bigram], own_word[bigram], tokens[bigram], batch.column(6).to_numpy(zero_copy_only=False)[bigram])
            for total, loss in zip(sums, found):
                total[bigram] = loss * n[bigram]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(7), *map(pa.array, sums)], names=["row", "doc_id", "n_tokens", *LOSSES])

    lines = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids", "is_target").mapInArrow(known, schema)
    rare = counts.where((F.col("background") > 1) & (F.col("background") < least)).hint("merge")
    met = lines.join(rare, "key", "left").select(*names, F.coalesce("background", F.lit(0)).alias("background"), F.coalesce("target", F.lit(0)).alias("target"))
    summed = met.mapInArrow(others, "row long, doc_id long, n_tokens long, target_loss double, background_loss double, corpus_loss double").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *[F.sum(x).alias(x) for x in LOSSES])
    mean = {x: F.col(x) / F.greatest("n_tokens", F.lit(1)) for x in LOSSES}
    return summed.select("doc_id", "n_tokens", mean["target_loss"].alias("target_loss"), mean["background_loss"].alias("background_loss"), (mean["target_loss"] - mean["background_loss"]).alias("difference"), mean["corpus_loss"].alias("corpus_loss"))


def cross_entropy_difference(df: DataFrame, labels: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Scores of every row of df (doc_id, text); the target are the rows that labels (doc_id, quality) call good."""
    path = tokenizer_path or token_store.default_tokenizer_path()
    encoder = token_store.word_encoder(path)
    rows = materialize(coded(df, labels, path), "token-ids")
    counts = materialize(count_bigrams(rows, encoder.dtype, encoder.size), "bigram-counts")
    return score(rows, counts, encoder.dtype, encoder.size)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
