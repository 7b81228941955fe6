"""Operator 1: SentencePiece encoding and decoding with a unigram model.

The vocabulary comes from a SentencePiece model file (never trained here). Pieces live in a double-array trie; Viterbi finds the best
segmentation under the pieces' log scores; characters that no piece covers become byte pieces. A model whose own scores are merge
ranks instead of log probabilities gets Zipf log scores by rank: ``log(1 / (rank + ZIPF_SHIFT)) - log Z``.

Of segmentations with equal scores, the one with the longest last piece is taken, and so on from the end. Scores are summed in 32 bits, from the start.

No piece may have the whitespace marker after another character, so a text's lattice falls apart in front of every marker run. Each such unit is
segmented once and remembered (a bounded memory; forgetting costs time only). Many new units are segmented together, a column at a time.

Models that would need more are refused: pieces with a marker inside, user-defined pieces, and normalisation other than the marker at the start.

Null and empty texts have no ids. Repeated rows give repeated results. A null doc_id is kept. Texts of any length are encoded whole.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import documents, map_text

MARK = "▁"
ZIPF_SHIFT = 2.7
UNKNOWN_PENALTY = 10.0
REMEMBERED_UNITS = 400_000
LONGEST_IN_BATCH = 40
SEARCH = 1024
_UNIT = re.compile(" *[^ ]+| +")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool = True
    base: np.ndarray = field(default=None, repr=False)
    check: np.ndarray = field(default=None, repr=False)
    value: np.ndarray = field(default=None, repr=False)
    code_of: dict = field(default_factory=dict, repr=False)
    code_table: np.ndarray = field(default=None, repr=False)
    byte_ids: list[int] = field(default_factory=list, repr=False)
    unknown_score: float = 0.0
    unknown_id: int = 0


NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def load_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    pieces, kinds = [p.piece for p in model.pieces], [p.type for p in model.pieces]
    scores = np.array([p.score for p in model.pieces], np.float32)
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model normalises texts in a way that isn't supported")
    if model.trainer_spec.model_type != 1:
        scores = zipf_scores(scores, kinds)
    return compile_vocabulary(Vocabulary(pieces, scores, kinds, model.normalizer_spec.add_dummy_prefix))


def zipf_scores(scores: np.ndarray, kinds: list[int]) -> np.ndarray:
    """Log scores from the order of merge ranks; equal ranks keep the order of ids."""
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    normal.sort(key=lambda i: (-scores[i], i))
    total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(1, len(normal) + 1)))
    out = np.zeros(len(scores), np.float32)
    for rank, i in enumerate(normal, 1):
        out[i] = -math.log(rank + ZIPF_SHIFT) - total
    return out


def compile_vocabulary(v: Vocabulary) -> Vocabulary:
    """Build the double array: the child of state s by code c is t = base[s] + c if check[t] == s."""
    if any(k == USER for k in v.kinds):
        raise ValueError("user-defined pieces aren't supported")
    if any(k == NORMAL and MARK in p.lstrip(MARK) for p, k in zip(v.pieces, v.kinds)):
        raise ValueError("a piece has the whitespace marker after another character")
    letters = sorted({c for p, k in zip(v.pieces, v.kinds) if k == NORMAL for c in p}, key=ord)
    v.code_of = {c: i for i, c in enumerate(letters, 1)}
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for i, (piece, kind) in enumerate(zip(v.pieces, v.kinds)):
        if kind != NORMAL:
            continue
        node = 0
        for ch in piece:
            code = v.code_of[ch]
            if code not in tree[node]:
                tree[node][code] = len(tree)
                tree.append({})
            node = tree[node][code]
        ends.setdefault(node, i)
    size = 2 * len(tree) + 2 * len(letters) + 2 * SEARCH
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    place, first_free = {0: 0}, 1
    for node, children in enumerate(tree):  # parents come before their children
        if not children:
            continue
        codes = np.array(sorted(children), np.int32)
        while not free[first_free]:
            first_free += 1
        start = first_free
        while True:
            if start + SEARCH + len(letters) + 1 >= size:
                base, check, value, free = (np.concatenate([x, np.full(size, fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (value, -1), (free, True)))
                size *= 2
            at = start + np.flatnonzero(free[start : start + SEARCH]) - codes[0]
            at = at[at >= 0]
            fits = free[at[:, None] + codes].all(axis=1)
            if fits.any():
                at = int(at[fits.argmax()])
                break
            start += SEARCH
        base[place[node]] = at
        free[at + codes] = False
        check[at + codes] = place[node]
        for code, child in children.items():
            place[child] = at + code
    for node, i in ends.items():
        value[place[node]] = i
    pad = len(letters) + 2  # base + code never leaves the arrays
    v.base, v.check, v.value = (np.append(x, np.full(pad, fill, np.int32)) for x, fill in ((base, 0), (check, -1), (value, -1)))
    v.code_table = np.zeros(0x110000, np.int32)
    for ch, code in v.code_of.items():
        v.code_table[ord(ch)] = code
    v.code_table[ord(" ")] = v.code_of.get(MARK, 0)
    names = {p: i for i, p in enumerate(v.pieces)}
    v.byte_ids = [names.get(f"<0x{b:02X}>", -1) for b in range(256)]
    v.unknown_id = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
    normal = [float(s) for s, k in zip(v.scores, v.kinds) if k == NORMAL]
    v.unknown_score = float(np.float32(min(normal, default=0.0)) - np.float32(UNKNOWN_PENALTY))
    return v


class Encoder:
    """Segments units under one vocabulary; ids of a unit are kept as little-endian int32 bytes."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known: dict[str, bytes] = {}
        self.byte_pieces = all(i >= 0 for i in v.byte_ids)
        self.plain = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(v.pieces, v.kinds)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [_UNIT.findall((" " + t if self.v.dummy_prefix else t)) if t else () for t in texts]
        new = list({u for units in split for u in units if u not in self.known})
        if len(self.known) + len(new) > REMEMBERED_UNITS:
            self.known = {}
            new = list({u for units in split for u in units})
        self.known.update(self._segment(new))
        known = self.known
        return [b"".join([known[u] for u in units]) for units in split]

    def decode(self, ids: bytes) -> str:
        plain = self.plain
        text = b"".join([plain[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text

    def _segment(self, units: list[str]) -> dict[str, bytes]:
        out = {}
        units.sort(key=len)
        short = [u for u in units if len(u) <= LONGEST_IN_BATCH]
        for at in range(0, len(short), 8192):
            out.update(self._segment_together(short[at : at + 8192]))
        for unit in units[len(short) :]:
            out[unit] = self._segment_alone(unit)
        return out

    def _ids(self, unit: str, cuts: list[tuple[int, int, int]]) -> bytes:
        ids = []
        for piece, start, end in cuts:
            if piece >= 0:
                ids.append(piece)
            elif self.byte_pieces:
                ids.extend(self.v.byte_ids[b] for b in unit[start:end].encode())
            else:
                ids.append(self.v.unknown_id)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _segment_together(self, units: list[str]) -> dict[str, bytes]:
        v, n = self.v, len(units)
        longest = max(map(len, units))
        length = np.array([len(u) for u in units])
        codes = np.zeros((n, longest), np.int32)
        codes[np.arange(longest) < length[:, None]] = v.code_table[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        score = np.full((n, longest + 1), -np.inf, np.float32)
        score[:, 0] = 0
        came = np.full((n, longest + 1), -1, np.int32)
        piece_at = np.full((n, longest + 1), -1, np.int32)
        scores, unknown = v.scores, np.float32(v.unknown_score)
        for i in range(longest):
            rows = np.flatnonzero(length > i)
            single = np.zeros(n, bool)
            live, state = rows, np.zeros(len(rows), np.int32)
            for j in range(i, longest):
                code = codes[live, j]
                nxt = v.base[state] + code
                ok = (code > 0) & (v.check[nxt] == state)
                live, state = live[ok], nxt[ok]
                if not len(live):
                    break
                piece = v.value[state]
                has = piece >= 0
                at, got = live[has], piece[has]
                if j == i:
                    single[at] = True
                total = score[at, i] + scores[got]
                better = total > score[at, j + 1]
                at, got = at[better], got[better]
                score[at, j + 1], came[at, j + 1], piece_at[at, j + 1] = total[better], i, got
            at = rows[~single[rows]]
            total = score[at, i] + unknown
            better = total > score[at, i + 1]
            at = at[better]
            score[at, i + 1], came[at, i + 1], piece_at[at, i + 1] = total[better], i, -1
        out = {}
        for unit, back, got, end in zip(units, came.tolist(), piece_at.tolist(), length.tolist()):
            cuts = []
            while end > 0:
                start = back[end]
                cuts.append((got[end], start, end))
                end = start
            out[unit] = self._ids(unit, cuts[::-1])
        return out

    def _segment_alone(self, unit: str) -> bytes:
        v, n = self.v, len(unit)
        base, check, value, scores = v.base, v.check, v.value, v.scores
        codes = [v.code_of.get(MARK if c == " " else c, 0) for c in unit]
        score, came, got = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = np.float32(0)
        unknown = np.float32(v.unknown_score)
        for i in range(n):
            state, single, here = 0, False, score[i]
            for j in range(i, n):
                code = codes[j]
                nxt = base[state] + code
                if not code or check[nxt] != state:
                    break
                state, piece = nxt, value[nxt]
                if piece >= 0:
                    single |= j == i
                    total = here + scores[piece]
                    if score[j + 1] is None or total > score[j + 1]:
                        score[j + 1], came[j + 1], got[j + 1] = total, i, int(piece)
            if not single and (score[i + 1] is None or here + unknown > score[i + 1]):
                score[i + 1], came[i + 1], got[i + 1] = here + unknown, i, -1
        cuts, end = [], n
        while end > 0:
            cuts.append((got[end], came[end], end))
            end = came[end]
        return self._ids(unit, cuts[::-1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps the trie and remembered units from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_vocabulary(path))
    return _ENCODERS[path]


def encode_documents(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids array<int>, round_trip (decoding the ids gives the text again)."""

    def run(ids, texts, enc):
        coded = enc.encode(texts)
        flat = np.frombuffer(b"".join(coded), "<i4")
        counts = np.array([len(c) // 4 for c in coded], np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        low, high = min(enc.v.byte_ids), max(enc.v.byte_ids)
        running = np.concatenate([[0], np.cumsum((flat >= low) & (flat <= high))])
        return {
            "doc_id": ids,
            "n_tokens": pa.array(counts),
            "n_byte_tokens": pa.array((running[offsets[1:]] - running[offsets[:-1]]).astype(np.int64)),
            "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
            "round_trip": [enc.decode(c) == (t or "").replace(MARK, " ") for c, t in zip(coded, texts)],
        }

    return map_text(df, run, "doc_id long, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean", setup=lambda: encoder(model_path), rows=1000)


def decode_documents(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of an ids column; null ids give an empty text, byte runs that are no UTF-8 give U+FFFD."""

    @F.pandas_udf("string")
    def decoded(ids):
        enc = encoder(model_path)
        return ids.map(lambda x: "" if x is None else enc.decode(np.asarray(x, "<i4").tobytes()))

    return df.select("doc_id", decoded("ids").alias("text"))


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), default_model_path())
