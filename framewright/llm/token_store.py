"""Operator 2: token-id shards with a minimal perfect hash index.

A shard is one binary file: raw little-endian ids (16 bits each if the vocabulary fits, else 32), then the sorted keys, the record offsets and an
index. The index is a minimal perfect hash over the shard's distinct keys, built in levels of collision-free bits with ranks; a slot
stores the key's fingerprint, its first record and its number of records. Looking up a key reads a constant number of places.

Spark range-partitions the documents by key and sorts each partition; each task writes one shard, to a name of its own attempt, and moves it into place, so
a task that runs again leaves the same file. A manifest table lists the shards; its running sums give each shard's first id.

Null texts count as empty (only the end id). Null keys come first and are reached by position, not by the index. Rows that share a key are kept, ordered by
a hash of their text, and may span shards; lookup in each returns them all. Shards are cut by the bytes of text. An empty table makes shards without records. Texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import documents, fresh_path, materialize, ranges, slices, word_hashes

MAGIC = b"FWTOKEN1"
END_ID = 2
GAMMA = 1.5
#: What a worker remembers at most, about 50 bytes a chunk and 200 a pre-token; forgetting costs time only.
REMEMBERED_CHUNKS, REMEMBERED_PRETOKENS = 500_000, 250_000
#: Likewise where only numbers of ids are remembered, about 150 bytes a chunk; and of how many new chunks the pre-tokens are encoded at once.
COUNTED_CHUNKS, COUNTED_PRETOKENS = 800_000, 600_000
READ_BYTES = 8 << 20
#: The vocabulary's own pre-tokens, and the line end that parts two chunks.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+|\n")
#: Letters that may change class or number when lowered or composed.
_BEYOND = regex.compile("[İ-\U0010ffff]")
#: Pre-tokens of texts without those letters, the white space that parts them, and what may hold white space of any kind, for Arrow.
_NARROW_SPACE = r"[\t\x0b-\r \x{85}\x{a0}]"
_NARROW_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x{85}\x{a0}\p{L}\p{N}]+"
_MAY_SPACE = "[\\x00-\\x20\\x7f-\\x{a0}İ-\U0010ffff]"
WORDS_A_LINE = 64
#: What each task compares with the library's ids of whole texts.
CHECKED_TEXTS, CHECKED_CHARACTERS = 10, 20_000
#: A shard holds about so much text; small inputs are cut finer, so that all cores have work.
BYTES_PER_SHARD, LEAST_PER_SHARD, ROW_BYTES = 64 << 20, 4 << 20, 64


# ---- ids -------------------------------------------------------------------------------------------------------------------


# The normaliser and splitter of the tokenizer file that pre-tokens are modelled on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def chunks_of(texts: pa.Array) -> pa.ListArray:
    """What lies between blanks in each text, lowered; texts with letters from U+0130 on are left to the library to lower, below it letters are lowered one by one, as the library does it."""
    lowered = pc.if_else(pc.match_substring_regex(texts, _BEYOND.pattern), texts, pc.utf8_lower(texts))
    return pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    If the file's normaliser and splitter are the ones modelled here, which never look across white space, each chunk between blanks is encoded once by the library and remembered; new chunks
    are first cut into the library's own pre-tokens, which repeat more. Texts are cut and ids gathered by Arrow and numpy for a whole batch. The first texts of every task are also encoded whole
    by the library, and a difference is an error. Under any other file the library encodes every text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        self.by_words = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _SPLITTER and parts["post_processor"] is None and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.size < 1 << 16 else "<u4"
        self.stop = np.iinfo(self.dtype).max  # no id; stands for the end of a chunk
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.chunks = pa.array([], pa.string())  # remembered; the ids of each lie in ids
        self.ids, self.starts, self.sizes, self.uses = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._forget_pretokens()

    def _forget_pretokens(self) -> None:
        self.pretokens = {"\n": np.array([self.stop], self.dtype).tobytes()}

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and the last one's end. Null texts are empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_words:
            coded = self._library(texts.to_pylist())
            return np.concatenate([np.zeros(0, self.dtype), *coded]), np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        parts = chunks_of(texts)
        coded = parts.flatten().dictionary_encode()
        slot = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.sizes[slot]
        return self.ids[ranges(self.starts[slot], sizes)], np.concatenate([[0], np.cumsum(sizes)])[parts.offsets.to_numpy()]

    def _slots(self, chunks: pa.Array) -> np.ndarray:
        """Where each of the distinct chunks is remembered; new ones are learned."""
        found = pc.index_in(chunks, value_set=self.chunks)
        if len(self.chunks) + found.null_count > REMEMBERED_CHUNKS:
            self._forget_rare()
            found = pc.index_in(chunks, value_set=self.chunks)
        slot = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        new = slot < 0
        if new.any():
            slot[new] = len(self.chunks) + np.arange(int(new.sum()))
            self._learn(chunks.filter(pa.array(new)))
        self.uses[slot] += 1
        return slot

    def _forget_rare(self) -> None:
        """Keep chunks that more than one batch had; all go if these are too many."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > REMEMBERED_CHUNKS // 2:
            self._forget()
            return
        starts, sizes = self.starts[kept], self.sizes[kept]
        self.chunks, self.ids = self.chunks.take(pa.array(kept)), self.ids[ranges(starts, sizes)]
        self.starts, self.sizes, self.uses = np.cumsum(sizes) - sizes, sizes, np.zeros(len(kept), np.int32)

    def check(self, texts: list[str | None]) -> None:
        """Raise if the ids of these texts aren't the library's ids of the whole texts."""
        ids, ends = self.encode(texts)
        for got, want in zip(np.split(ids, ends[1:-1]), self._library([t or "" for t in texts])):
            if not np.array_equal(got, want):
                raise ValueError("ids of pre-tokens differ from the library's ids of the whole text")

    def _learn(self, new: pa.Array) -> None:
        """Remember the chunks, in their order."""
        chunks = new.to_pylist()
        text = "\n".join(chunks)
        pieces = _PRETOKEN.findall(text.lower() + "\n")
        missing = list(set(pieces).difference(self.pretokens))
        if len(self.pretokens) + len(missing) > REMEMBERED_PRETOKENS:
            self._forget_pretokens()
            missing = list(set(pieces).difference(self.pretokens))
        self.pretokens.update(zip(missing, self._words(missing)))
        ids = np.frombuffer(b"".join(map(self.pretokens.__getitem__, pieces)), self.dtype)
        ends = np.flatnonzero(ids == self.stop)
        starts = np.concatenate([[0], ends[:-1] + 1])
        sizes = ends - starts
        if _BEYOND.search(text) or any(a in text for a in self.added):
            odd = [i for i, c in enumerate(chunks) if _BEYOND.search(c) or any(a in c for a in self.added)]
            coded = self._library([chunks[i] for i in odd])
            sizes[odd] = [len(c) for c in coded]
            starts[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
            ids = np.concatenate([ids, *coded])
        self.starts, self.sizes = np.concatenate([self.starts, starts + len(self.ids)]), np.concatenate([self.sizes, sizes])
        self.ids, self.uses = np.concatenate([self.ids, ids]), np.concatenate([self.uses, np.zeros(len(chunks), np.int32)])
        self.chunks = pa.concat_arrays([self.chunks, new])

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each pre-token."""
        for ids, sizes in self._cut(words):
            ends = np.cumsum(sizes).tolist()
            yield from (ids[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends))

    def _cut(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of many pre-tokens and how many each has. Many share a line, as the ids themselves tell where each ends; if they don't, each is encoded alone."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            lines = [" ".join(part[i : i + WORDS_A_LINE]) for i in range(0, len(part), WORDS_A_LINE)]
            ids = np.concatenate(self._library(lines))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                yield ids, np.diff(ends, prepend=0)
            else:
                alone = self._library(part)
                yield np.concatenate(alone), np.array([len(c) for c in alone])

    def _library(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for at in range(0, len(pieces), 4096) for e in self.tokenizer.encode_batch_fast(pieces[at : at + 4096], add_special_tokens=False)]


def _ranks(path: str) -> dict[bytes, int] | None:
    """The bytes of every entry of a tokenizer file, a line end where an entry ends a word, and their ids; None unless merges are numbered as their ids, after the single bytes.

    Then the tiktoken library, which joins the neighbours of lowest id as long as some can be joined, gives a word and a line end the ids that the file's merges give the word, if every entry is given itself (tests).
    """
    from framewright.llm.cross_alignment import _byte_letters

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, vocabulary = _byte_letters(), model["vocab"]
    single = [*letters, *(f"{letter}</w>" for letter in letters)]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if model.get("ignore_merges") or len(vocabulary) != len(single) + len(merged) or {vocabulary.get(t) for t in single} != set(range(len(single))) or [vocabulary.get(t) for t in merged] != list(range(len(single), len(vocabulary))):
        return None
    ranks = {}
    for entry, i in vocabulary.items():
        ends = i >= len(letters) and entry.endswith("</w>")
        ranks[bytes(map(letters.__getitem__, entry.removesuffix("</w>") if ends else entry)) + b"\n" * ends] = i
    return ranks if len(ranks) == len(vocabulary) else None


class WordCounter:
    """Numbers of ids of whole texts, and the hashes of their words (``common.word_hashes``), from one cut of each text: a chunk's number of ids and word are found once and remembered, its ids are not kept.

    Pre-tokens of new chunks are cut by Arrow and encoded by the tiktoken library with the file's own vocabulary, many at once. Chunks with letters that may change when lowered or composed are encoded by the
    tokenizers library, and so is everything under files that tiktoken doesn't match.
    """

    def __init__(self, encoder: WordEncoder):
        import tiktoken

        self.encoder = encoder
        ranks = _ranks(encoder.path) if encoder.by_words else None
        self.line_end = ranks and ranks[b"\n"]
        self.fast = ranks and tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.sizes, self.words, self.several, self.uses = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int32)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of ids of each text; the hashes of all words, and where each text's begin and the last one's end. Null texts are empty."""
        texts = pc.fill_null(texts, "")
        if not (self.encoder.by_words and self.fast):
            return np.diff(self.encoder.encode(texts)[1]), *word_hashes(texts)
        parts = chunks_of(texts)
        coded = parts.flatten().dictionary_encode()
        slot, each, bounds = self._slots(coded.dictionary), coded.indices.to_numpy(), parts.offsets.to_numpy()
        sizes = np.diff(np.concatenate([[0], np.cumsum(self.sizes[slot][each])])[bounds])
        found = self.words[slot][each]
        is_word = found != 0
        words, ends = found[is_word], np.concatenate([[0], np.cumsum(is_word)])[bounds]
        if (odd := self.several[slot]).any():
            # other white space than blanks and line ends parts these texts further
            odd = np.unique(np.searchsorted(bounds, np.flatnonzero(odd[each]), side="right") - 1)
            more, cuts = word_hashes(texts.take(pa.array(odd)))
            each = np.split(words, ends[1:-1])
            for i, start, end in zip(odd.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                each[i] = more[start:end]
            words, ends = np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])
        return sizes, words, ends

    def check(self, texts: list[str | None]) -> None:
        """Raise if the numbers of ids of these texts aren't those of the library for the whole texts."""
        if self.count(pa.array(texts, pa.string()))[0].tolist() != [len(c) for c in self.encoder._library([t or "" for t in texts])]:
            raise ValueError("numbers of ids of chunks differ from the library's for the whole text")

    def _slots(self, chunks: pa.Array) -> np.ndarray:
        """Where each of the distinct chunks is remembered; new ones are learned. If these are too many, chunks that only one batch had are forgotten first, or all."""
        names = chunks.to_numpy(zero_copy_only=False)
        slot = self._find(names)
        if len(self.slots) + int((slot < 0).sum()) > COUNTED_CHUNKS:
            kept = np.flatnonzero(self.uses > 1)
            if len(kept) > COUNTED_CHUNKS // 2:
                self._forget()
            else:
                self.slots = dict(zip(np.array([*self.slots], object)[kept], range(len(kept))))
                self.sizes, self.words, self.several, self.uses = self.sizes[kept], self.words[kept], self.several[kept], np.zeros(len(kept), np.int32)
            slot = self._find(names)
        new = slot < 0
        if new.any():
            slot[new] = len(self.slots) + np.arange(int(new.sum()))
            self._learn(chunks.filter(pa.array(new)))
            self.slots.update(zip(names[new], slot[new].tolist()))
        self.uses[slot] += 1
        return slot

    def _find(self, names: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.slots.get, names, repeat(-1)), np.int64, len(names))

    def _learn(self, new: pa.Array) -> None:
        lowered = pc.utf8_lower(new)
        alone = pc.match_substring_regex(new, _BEYOND.pattern)
        for added in self.encoder.added:
            alone = pc.or_(alone, pc.match_substring(new, added))
        plain = pc.if_else(alone, "", lowered)
        sizes = np.concatenate([self._sizes(plain.slice(at, COUNTED_PRETOKENS)) for at in range(0, len(new), COUNTED_PRETOKENS)])
        odd = np.flatnonzero(alone.to_numpy(zero_copy_only=False))
        sizes[odd] = [len(c) for c in self.encoder._library(new.take(pa.array(odd)).to_pylist())]
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in lowered.to_numpy(zero_copy_only=False)), np.uint64, len(new))
        several = np.zeros(len(new), bool)
        odd = np.flatnonzero(pc.match_substring_regex(new, _MAY_SPACE).to_numpy(zero_copy_only=False))
        more, ends = word_hashes(new.take(pa.array(odd)))
        each = np.diff(ends)
        words[odd], several[odd] = np.where(each > 0, np.concatenate([more, np.zeros(1, np.uint64)])[ends[:-1]], np.uint64(0)), each > 1
        self.sizes, self.words = np.concatenate([self.sizes, sizes]), np.concatenate([self.words, words])
        self.several, self.uses = np.concatenate([self.several, several]), np.concatenate([self.uses, np.zeros(len(new), np.int32)])

    def _sizes(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of ids of lowered chunks of letters below U+0130: a line for each pre-token and an empty one after each chunk."""
        lines = pc.replace_substring_regex(chunks, _NARROW_PRETOKEN, "\\0\n")
        if pc.any(pc.match_substring_regex(lines, _NARROW_SPACE)).as_py():
            lines = pc.replace_substring_regex(lines, _NARROW_SPACE, "")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py() + "\n"
        return np.diff(np.flatnonzero(self.fast.encode_to_numpy(text, disallowed_special=()) == self.line_end), prepend=-1) - 1


_ENCODERS: dict[str, WordEncoder] = {}
_COUNTERS: dict[str, WordCounter] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps what it remembers from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def word_counter(path: str) -> WordCounter:
    """One for each Python worker, like ``word_encoder``."""
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(word_encoder(path))
    return _COUNTERS[path]


def encoded(batches: Iterator[pa.RecordBatch], column: int, path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches, each with the ids of its texts and where each text's begin and the last one's end."""
    encoder, checked = word_encoder(path), False
    for whole in batches:
        for batch in slices(whole, column):
            if not checked:
                encoder.check([t[:CHECKED_CHARACTERS] if t else t for t in batch.column(column).slice(0, CHECKED_TEXTS).to_pylist()])
                checked = True
            yield batch, *encoder.encode(batch.column(column))


# ---- minimal perfect hash ------------------------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bits: a key belongs to the first level where no other key shares its slot; its index is the rank of that bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # uint64 words
        self.ranks, total = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.concatenate([[0], np.cumsum(counts)[:-1]]))
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            slots = 64 * max(1, -(-int(len(left) * GAMMA) // 64))
            slot = (_mix(left, len(levels)) % np.uint64(slots)).astype(np.int64)
            alone = np.bincount(slot, minlength=slots) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[slot]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; some slot or -1 for a key that isn't stored, which the fingerprint tells."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            slot = _mix(keys[open_], level) % np.uint64(64 * len(words))
            word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = ranks[word] + np.bitwise_count(below).astype(np.int64)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(w)) + w.astype("<u8").tobytes() for w in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            levels.append(np.frombuffer(data, "<u8", size, at + 8).astype(np.uint64))
            at += 8 + 8 * size
        return cls(levels)


# ---- shard files -----------------------------------------------------------------------------------------------------------------


_TAIL = struct.Struct("<2sqqqqq8s")  # dtype, payload bytes, records, records of null keys, distinct keys, bytes of the hash, magic


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write_shard(path: str, parts: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], dtype: str) -> tuple[int, int]:
    """Write records in the order given, keys ascending and nulls first; returns the numbers of records and ids. parts: keys, their numbers of ids, ids."""
    store, target = filesystem(path)
    part = f"{target}.{uuid.uuid4().hex}.part"
    store.create_dir(os.path.dirname(target), recursive=True)
    width = np.dtype(dtype).itemsize
    keys, sizes, nulls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    with store.open_output_stream(part) as out:
        for some, counts, ids in parts:
            out.write(ids.astype(dtype).tobytes())
            nulls += some.null_count
            keys.append(some.drop_null().to_numpy())
            sizes.append(counts * width)
        key, offset = np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        distinct, first, count = np.unique(key, return_index=True, return_counts=True)
        table = PerfectHash.build(distinct)
        slot = table.index(distinct)
        index = np.zeros(len(distinct), np.dtype([("print", "<u4"), ("count", "<u4"), ("record", "<u8")]))
        index["print"][slot], index["count"][slot], index["record"][slot] = fingerprint(distinct), count, first + nulls
        mph = table.to_bytes()
        for part_bytes in (key.astype("<i8"), offset.astype("<i8"), index):
            out.write(part_bytes.tobytes())
        out.write(mph)
        out.write(_TAIL.pack(b"u%d" % width, int(offset[-1]), len(key) + nulls, nulls, len(distinct), len(mph), MAGIC))
    store.move(part, target)
    return len(key) + nulls, int(offset[-1]) // width


class Shard:
    """A shard file opened for reading; the payload stays in the file."""

    def __init__(self, path: str):
        store, target = filesystem(path)
        self.file = store.open_input_file(target)
        size = self.file.size()
        dtype, self.payload, self.records, self.nulls, self.distinct, mph, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.dtype = f"<{dtype.decode()}"
        at = self.payload
        self.keys = np.frombuffer(self.file.read_at(8 * (self.records - self.nulls), at), "<i8")
        at += 8 * (self.records - self.nulls)
        self.offsets = np.frombuffer(self.file.read_at(8 * (self.records + 1), at), "<i8")
        at += 8 * (self.records + 1)
        self.index = np.frombuffer(self.file.read_at(16 * self.distinct, at), np.dtype([("print", "<u4"), ("count", "<u4"), ("record", "<u8")]))
        self.table = PerfectHash.from_bytes(self.file.read_at(mph, at + 16 * self.distinct))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; (-1, 0) for keys that aren't here."""
        slot = self.table.index(keys)
        if not self.distinct:
            return slot, np.zeros(len(keys), np.int64)
        entry = self.index[np.maximum(slot, 0)]
        found = (slot >= 0) & (entry["print"] == fingerprint(keys))
        return np.where(found, entry["record"].astype(np.int64), -1), np.where(found, entry["count"].astype(np.int64), 0)

    def ids(self, record: int) -> np.ndarray:
        start, end = int(self.offsets[record]), int(self.offsets[record + 1])
        return np.frombuffer(self.file.read_at(end - start, start), self.dtype)

    def lookup(self, key: int) -> list[np.ndarray]:
        record, count = (int(x[0]) for x in self.find(np.array([key], np.int64)))
        return [self.ids(r) for r in range(record, record + count)]

    def scan(self, records: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Ids of ascending records, read in blocks."""
        at = 0
        while at < len(records):
            start = int(self.offsets[records[at]])
            end = max(at + 1, int(np.searchsorted(self.offsets[records + 1], start + READ_BYTES, side="right")))
            block = self.file.read_at(int(self.offsets[records[end - 1] + 1]) - start, start)
            for r in records[at:end].tolist():
                yield r, np.frombuffer(block, self.dtype, (int(self.offsets[r + 1]) - int(self.offsets[r])) // np.dtype(self.dtype).itemsize, int(self.offsets[r]) - start)
            at = end


# ---- Spark ---------------------------------------------------------------------------------------------------------------------------


def shards_for(df: DataFrame) -> int:
    """As many shards as the table's text needs: BYTES_PER_SHARD each, where a row counts ROW_BYTES more for its key and offsets."""
    total = df.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    return max(1, -(-total // BYTES_PER_SHARD), min(df.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_PER_SHARD)))


def write_store(df: DataFrame, tokenizer_path: str, folder: str, shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Write doc_id, text as shards in ascending order of doc_id; returns the manifest: shard, path, n_records, n_ids, first_id."""
    placed = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = shards or shards_for(placed)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()

        def parts():
            for batch, ids, ends in encoded(batches, 1, tokenizer_path):
                yield batch.column(0), np.diff(ends) + 1, np.insert(ids, ends[1:], end_id)

        path = f"{folder}/shard-{shard:06d}.tok"
        n_records, n_ids = write_shard(path, parts(), word_encoder(tokenizer_path).dtype)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_records": [n_records], "n_ids": [n_ids]})

    # equal rows are dealt by their places too, so that no number of them has to fit one shard
    placed = placed.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    placed = placed.repartitionByRange(shards, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = materialize(placed.mapInArrow(write, "shard long, path string, n_records long, n_ids long"), "token-manifest")
    # one row a shard: its running sum is small however large the corpus
    first = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("first_id", first)


def read_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every record, each key found through the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                distinct, count = np.unique(shard.keys, return_counts=True)
                record, stored = shard.find(distinct)
                if not (stored == count).all():
                    raise ValueError(f"the index of {row['path']} misses keys")
                order = np.concatenate([np.arange(shard.nulls), np.repeat(record, stored) + _within(stored)]).astype(np.int64)
                keys = [None] * shard.nulls + np.repeat(distinct, stored).tolist()
                width = np.dtype(shard.dtype).itemsize
                for at in range(0, len(order), 20_000):
                    part = order[at : at + 20_000]
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in shard.scan(part)]
                    starts, ends = shard.offsets[part], shard.offsets[part + 1]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[at : at + 20_000], pa.int64()), "start": row["first_id"] + starts // width, "n_tokens": (ends - starts) // width, "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([row["shard"]] * len(part), pa.int64())})

    return manifest.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_store(documents(spark, sf_dir), default_tokenizer_path(), fresh_path(spark, "token-store"))
    return read_store(manifest)
