"""Operator 4: language identification with a byte convolutional network.

A window of bytes is embedded, convolved with filters of several widths, max-pooled over the window and classified by softmax. The network is
trained in numpy on a bounded sample of labelled rows (``sample_per_language`` windows of each language, drawn by a hash of the id, so the same rows at every run). Prediction
cuts each whole text into windows of fixed length, runs them in batches and averages the windows' probabilities by their bytes.

A null text, or one without a letter (``str.isalpha``), is ``und`` with score 0. Every labelled language is learned; only the windows of each are bounded. Equal probabilities go to the language that sorts first. Rows with a null language
or id teach nothing. ``fit_known`` adds a class of counterfeits (garbled and transcribed windows), so that text in no learned language is ``und`` too, and sets the least score
from windows that it didn't learn. An empty or unlabelled table trains no language: every row is ``und``. Repeated rows give repeated results.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import documents, fold_of, map_text

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 16
SAMPLE_PER_LANGUAGE = 1500
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.01, 7
UNDETERMINED = "und"
#: Where the letters of the scripts begin that counterfeits are written in.
SCRIPTS = (0x61, 0xE0, 0x100, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0x3041, 0x4E00)


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads
    filters: list[np.ndarray]  # one FILTERS x (EMBED * width) for each width
    filter_bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    data = np.frombuffer(text.lower().replace("\0", " ").encode(), np.uint8)
    rows = max(1, -(-len(data) // size))
    out = np.zeros(rows * size, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, size)


def _convolve(net: Network, x: np.ndarray, k: int, spread: np.ndarray) -> np.ndarray:
    """Filter responses, FILTERS x windows x positions. spread: EMBED x all bytes."""
    width, m = WIDTHS[k], spread.shape[1]
    shifted = np.zeros((width * EMBED, m), np.float32)
    for j in range(width):
        shifted[j * EMBED : (j + 1) * EMBED, : m - j] = spread[:, j:]
    return (net.filters[k] @ shifted).reshape(FILTERS, *x.shape)[:, :, : WINDOW - width + 1]


def _spread(net: Network, x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(net.embed.T)[:, x.ravel()]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, x: np.ndarray, batch: int = 256) -> np.ndarray:
    out = []
    for at in range(0, len(x), batch):
        part = x[at : at + batch]
        spread = _spread(net, part)
        pooled = [np.maximum(_convolve(net, part, k, spread).max(axis=2).T + net.filter_bias[k], 0) for k in range(len(WIDTHS))]
        out.append(_softmax(np.concatenate(pooled, axis=1) @ net.dense + net.dense_bias))
    return np.concatenate(out) if out else np.zeros((0, len(net.languages)), np.float32)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS) -> Network:
    """Fit on one window of each text by Adam; a third of the windows are cut short so that short texts are known too."""
    rng = np.random.default_rng(SEED)
    languages = sorted(set(labels))
    place = {name: i for i, name in enumerate(languages)}
    y = np.array([place[name] for name in labels])
    x = np.stack([windows_of(t)[0] for t in texts])
    net = Network(languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), [rng.normal(0, 1 / np.sqrt(w * EMBED), (FILTERS, w * EMBED)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embed[0] = 0
    params = [net.embed, *net.filters, *net.filter_bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            part = x[rows].copy()
            cut = rng.integers(12, WINDOW, len(rows))
            part[(np.arange(WINDOW) >= cut[:, None]) & (rng.random(len(rows)) < 1 / 3)[:, None]] = 0
            step += 1
            for p, g, a, b in zip(params, _gradients(net, part, y[rows]), first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.embed[0] = 0
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, spread = len(x), _spread(net, x)
    where, pooled = [], []
    for k in range(len(WIDTHS)):
        response = _convolve(net, x, k, spread)
        best = response.argmax(axis=2)  # FILTERS x n
        where.append(best)
        pooled.append(np.take_along_axis(response, best[:, :, None], 2)[:, :, 0].T + net.filter_bias[k])
    hidden = np.concatenate([np.maximum(p, 0) for p in pooled], axis=1)
    d_out = _softmax(hidden @ net.dense + net.dense_bias)
    d_out[np.arange(n), y] -= 1
    d_out /= n
    d_hidden = d_out @ net.dense.T
    d_embed, d_filters, d_bias = np.zeros_like(net.embed), [], []
    for k, width in enumerate(WIDTHS):
        d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS] * (pooled[k] > 0)
        bytes_at = x[np.arange(n)[:, None, None], where[k].T[:, :, None] + np.arange(width)]  # n x FILTERS x width
        patch = net.embed[bytes_at]
        d_filters.append(np.einsum("nf,nfwe->fwe", d, patch).reshape(FILTERS, -1).astype(np.float32))
        d_bias.append(d.sum(axis=0))
        back = d[:, :, None, None] * net.filters[k].reshape(1, FILTERS, width, EMBED)
        np.add.at(d_embed, bytes_at.ravel(), back.reshape(-1, EMBED))
    return [d_embed, *d_filters, *d_bias, hidden.T @ d_out, d_out.sum(axis=0)]


def labelled_windows(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """A bounded sample: about per_language texts of each language, one stretch of WINDOW characters of each, chosen by hashes of the id."""
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return [], []
    rate = F.create_map(*(x for row in counts for x in (F.lit(row["lang"]), F.lit(min(1.0, per_language / row["n"])))))
    start = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1
    rows = labelled.where(share < rate[F.col("lang")]).select("doc_id", "lang", F.col("text").substr(start.cast("int"), F.lit(WINDOW)).alias("part")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["part"]))
    rows = [r for r in rows if has_letter(r["part"])]
    return [r["part"] for r in rows], [r["lang"] for r in rows]


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """Train on rows (doc_id, text, lang); rows with a null field are left out."""
    texts, labels = labelled_windows(labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"), per_language)
    return train(texts, labels) if texts else None


def disguised(texts: list[str], seed: int = SEED) -> list[str]:
    """Counterfeits of texts: letters shuffled over the text or in each word, swapped for one another, or transcribed to letters of some script. A text that comes out as it was is left out."""
    rng, out = random.Random(seed), []
    for text in texts:
        text, kind = text.lower(), rng.randrange(4)
        if kind == 0:
            made = "".join(rng.sample(text, len(text)))
        elif kind == 1:
            made = " ".join("".join(rng.sample(w, len(w))) for w in text.split(" "))
        elif kind == 2:
            letters = sorted({c for c in text if c.isalpha()})
            swap = dict(zip(letters, rng.sample(letters, len(letters))))
            made = "".join(swap.get(c, c) for c in text)
        else:
            first, to = rng.choice(SCRIPTS), {}
            made = "".join(chr(first + to.setdefault(c, rng.randrange(26))) if c.isalpha() else c for c in text)
        if made != text:
            out.append(made)
    return out


def fit_known(labelled: DataFrame, held_out: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[Network | None, float]:
    """A network with a class of counterfeits, and the least score that tells held-out windows from their counterfeits best (the lowest of equals; 0 without held-out rows)."""
    complete = "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"
    texts, labels = labelled_windows(labelled.where(complete), per_language)
    if not texts:
        return None, 0.0
    false = disguised(texts)
    net = train(texts + false, labels + [UNDETERMINED] * len(false))
    true, _ = labelled_windows(held_out.where(complete), per_language)
    marks = [np.array([s if lang != UNDETERMINED else 0.0 for lang, s in zip(*_predicted(net, some))]) for some in (true, disguised(true, SEED + 1))]
    if not len(marks[0]) or not len(marks[1]):
        return net, 0.0
    levels = np.unique(np.concatenate(marks))
    kept = [1 - np.searchsorted(np.sort(m), levels) / len(m) for m in marks]
    return net, float(levels[int((kept[0] - kept[1]).argmax())])


def predict(df: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text."""

    def run(ids, texts):
        langs, scores = _predicted(net, texts)
        return {"doc_id": ids, "lang_pred": langs, "score": scores}

    return map_text(df, run, "doc_id long, lang_pred string, score double", rows=500)


def _predicted(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
    for at in range(0, len(known), 200):
        some = known[at : at + 200]
        parts = [windows_of(texts[i]) for i in some]
        x = np.concatenate(parts)
        filled = (x != 0).sum(axis=1)[:, None]
        ends = np.cumsum([0] + [len(p) for p in parts])[:-1]
        total = np.add.reduceat(probabilities(net, x) * filled, ends, axis=0) / np.add.reduceat(filled, ends, axis=0)
        for i, p in zip(some, total):
            best = int(p.argmax())
            langs[i], scores[i] = net.languages[best], float(min(1.0, max(0.0, p[best])))
    return langs, scores


def keep_identified(df: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The rows and columns of df whose language is determined with a score of at least ``least``."""

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        out = []
        for at in range(0, len(texts), 500):
            langs, scores = _predicted(net, texts.iloc[at : at + 500].tolist())
            out += [lang != UNDETERMINED and s >= least for lang, s in zip(langs, scores)]
        return pd.Series(out, dtype=bool)

    return df.where(known(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def identify(df: DataFrame) -> DataFrame:
    """Learn from two of three folds and predict every row: doc_id, held_out, lang_pred, score."""
    net = fit(df.where(fold_of("doc_id", 3) != 1))
    return predict(df, net).select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
