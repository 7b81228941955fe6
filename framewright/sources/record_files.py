"""Record files: length-framed records with masked CRC-32C, each an ``Example`` message of named features; written by tasks, read as a data source.

A record is an 8-byte length, the length's masked checksum, the message and its masked checksum. Nothing in a file marks where records begin, so the writer's manifest says so for a record every few megabytes: from these on a
file is read by several tasks. A file that no manifest names is read by one.
What can't be read is a row with its ``reason``, never an error: a record whose checksum differs or whose message can't be parsed (reading goes on behind it), and a frame whose length is wrong (nothing behind it can be found, up to
the next place that the manifest names). Checksums of a batch of records are computed at once: the sum is linear, so all pieces of all records advance together and are joined by the operator that skips zeros.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewright.sources.commits import open_store, stream_lines

BYTES_A_FILE, BYTES_A_TASK, BYTES_A_BATCH, ROWS_A_BATCH, READ = 128 << 20, 8 << 20, 4 << 20, 4096, 1 << 20
#: A length beyond this is taken as damage even if its checksum is right.
LONGEST = 1 << 31
PIECE, SKIP = 64, 6  # bytes of a piece, and its power of two
# Fixed values of the format: the reversed polynomial of CRC-32C and what masks a checksum.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


class BadMessage(ValueError):
    """A record that isn't an ``Example``, or whose feature isn't of the column's kind."""


# ---- checksums


@lru_cache(maxsize=1)
def _by_byte() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(POLYNOMIAL), state >> 1).astype(np.uint32)
    return state


@lru_cache(maxsize=64)
def _skip(power: int) -> np.ndarray:
    """Four tables, one a byte of the state, that advance it over 2**power zero bytes."""
    if power == 0:
        state = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        return (_by_byte()[state & 255] ^ (state >> 8)).reshape(4, 256)
    half = _skip(power - 1)
    return _advance(half, half.ravel()).reshape(4, 256)


def _advance(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][(state >> 8) & 255] ^ tables[2][(state >> 16) & 255] ^ tables[3][state >> 24]


def masked_sums(records: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of every record."""
    n = len(records)
    if not n:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, records), np.int64, n)
    pieces = -(-sizes // PIECE)
    ends = np.cumsum(pieces)
    # each record ends at the end of a piece: zeros in front of it leave a state of zero as it is
    padded = np.zeros(int(ends[-1]) * PIECE, np.uint8)
    for record, end, size in zip(records, ends.tolist(), sizes.tolist()):
        padded[end * PIECE - size : end * PIECE] = np.frombuffer(record, np.uint8)
    columns = np.ascontiguousarray(padded.reshape(-1, PIECE).T)
    table, state = _by_byte(), np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state = table[(state ^ column) & 255] ^ (state >> 8)
    # longest first, so that those that have a next piece from the front are a slice
    order = np.argsort(-pieces, kind="stable")
    starts, left, skip = (ends - pieces)[order], pieces[order], _skip(SKIP)
    total = np.zeros(n, np.uint32)
    for i in range(int(left[0])):
        k = int(np.searchsorted(-left, -i, side="left"))
        total[:k] = _advance(skip, total[:k]) ^ state[starts[:k] + i]
    sums = np.empty(n, np.uint32)
    sums[order] = total
    begin = np.full(n, 0xFFFFFFFF, np.uint32)  # what the first state of ones adds, moved over the whole record
    for power in range(int(sizes.max()).bit_length()):
        some = (sizes >> power) & 1 == 1
        begin[some] = _advance(_skip(power), begin[some])
    sums ^= begin ^ np.uint32(0xFFFFFFFF)
    return ((sums >> 15) | (sums << 17)) + np.uint32(MASK)


def frames_of(messages: list[bytes]) -> list[bytes]:
    """Records with their lengths and checksums around them."""
    lengths = [struct.pack("<Q", len(m)) for m in messages]
    return [b"".join((length, struct.pack("<I", a), message, struct.pack("<I", b))) for length, a, message, b in zip(lengths, masked_sums(lengths).tolist(), messages, masked_sums(messages).tolist())]


# ---- messages

ONE_FLOAT = struct.Struct("<f")
KINDS = {1: "bytes", 2: "float", 3: "int"}
NUMBERS = {kind: number for number, kind in KINDS.items()}
ONE_BYTE = [bytes([i]) for i in range(128)]


def _varint(value: int) -> bytes:
    if 0 <= value < 128:
        return ONE_BYTE[value]
    out, value = bytearray(), value & 0xFFFFFFFFFFFFFFFF
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _read_varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while at < end and shift < 70:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & 0xFFFFFFFFFFFFFFFF, at
    raise BadMessage("a number that doesn't end")


def _field(number: int, content: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _fields(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """number, wire type, begin and end of each field's content."""
    while at < end:
        tag = data[at]
        if tag < 128:
            at += 1
        else:
            tag, at = _read_varint(data, at, end)
        number, wire = tag >> 3, tag & 7
        if wire == 2:
            if at < end and (size := data[at]) < 128:
                begin = at + 1
            else:
                size, begin = _read_varint(data, at, end)
            at = begin + size
        elif wire == 0:
            begin, at = at, _read_varint(data, at, end)[1]
        elif wire in (1, 5):
            begin, at = at, at + (8 if wire == 1 else 4)
        else:
            raise BadMessage(f"a field of wire type {wire}")
        if at > end or not number:
            raise BadMessage("a field that doesn't fit")
        yield number, wire, begin, at


@lru_cache(maxsize=1 << 14)
def _head(name: str, number: int, size: int) -> bytes:
    """What stands in front of a feature's only value of so many bytes."""
    held = _field(number, _field(1, bytes(size)))
    entry = _field(1, _field(1, name.encode()) + _field(2, held))
    return entry[: len(entry) - size]


def encode(features: dict[str, tuple[str, list]]) -> bytes:
    """An Example; features: name to kind (bytes, float or int) and values."""
    entries = []
    for name, (kind, values) in features.items():
        if len(values) == 1:
            value = values[0]
            value = value if kind == "bytes" else _varint(value) if kind == "int" else ONE_FLOAT.pack(value) if abs(value) < 3e38 else np.float32(value).tobytes()
            entries.append(_head(name, NUMBERS[kind], len(value)) + value if len(value) < 4096 else _field(1, _field(1, name.encode()) + _field(2, _field(NUMBERS[kind], _field(1, value)))))
            continue
        if kind == "bytes":
            held = _field(1, b"".join(_field(1, v) for v in values))
        elif kind == "float":
            packed = np.asarray(values, "<f4").tobytes()
            held = _field(2, _field(1, packed) if values else b"")
        else:
            packed = b"".join(map(_varint, values))
            held = _field(3, _field(1, packed) if values else b"")
        entries.append(_field(1, _field(1, name.encode()) + _field(2, held)))
    return _field(1, b"".join(entries))


def _values(data: bytes, kind: int, begin: int, end: int) -> list:
    out: list = []
    for number, wire, at, stop in _fields(data, begin, end):
        if number != 1:
            continue
        if kind == 1 and wire == 2:
            out.append(data[at:stop])
        elif kind == 2 and stop - at == 4:
            out.append(ONE_FLOAT.unpack_from(data, at)[0])
        elif kind == 2 and (wire == 5 or wire == 2 and (stop - at) % 4 == 0):
            out += np.frombuffer(data, "<f4", (stop - at) // 4, at).tolist()
        elif kind == 3 and wire in (0, 2):
            while at < stop:
                value, at = _read_varint(data, at, stop)
                out.append(value - (1 << 64) if value >> 63 else value)
        else:
            raise BadMessage("values of another kind than their list's")
    return out


def decode(data: bytes, wanted: set[str] | None = None) -> dict[str, tuple[str, list]]:
    """Features of an Example, those that are wanted or all; of a repeated name the last counts, unknown fields are passed over."""
    found: dict[str, tuple[str, list]] = {}
    for number, wire, begin, end in _fields(data, 0, len(data)):
        if number != 1 or wire != 2:
            continue
        for number, wire, a, z in _fields(data, begin, end):
            if number != 1 or wire != 2:
                continue
            name, held = "", []
            for number, wire, s, e in _fields(data, a, z):
                if wire == 2 and number == 1:
                    try:
                        name = data[s:e].decode()
                    except UnicodeDecodeError as reason:
                        raise BadMessage("a name that isn't text") from reason
                elif wire == 2 and number == 2:
                    held.append((s, e))
            if wanted is not None and name not in wanted:
                continue
            kind, values = "", []
            for s, e in held:
                for number, wire, low, high in _fields(data, s, e):
                    if number in KINDS and wire == 2:
                        values = values if kind == KINDS[number] else []
                        kind = KINDS[number]
                        values = values + _values(data, number, low, high)
            if kind:
                found[name] = kind, values
            else:
                found.pop(name, None)
    return found


def kind_of(column: T.DataType) -> str:
    """What a column, or an array's elements, are stored as."""
    if isinstance(column, T.ArrayType):
        return kind_of(column.elementType) if not isinstance(column.elementType, T.ArrayType) else ""
    kinds = {"bytes": (T.StringType, T.BinaryType), "float": (T.FloatType, T.DoubleType), "int": (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)}
    return next((kind for kind, types in kinds.items() if isinstance(column, types)), "")


# ---- writing


def write_records(df: DataFrame, root: str, bytes_a_file: int = BYTES_A_FILE, bytes_a_task: int = BYTES_A_TASK) -> None:
    """Write rows as Examples. Strings are stored in UTF-8, whole numbers and booleans as int64, fractions as 32-bit floats (the format has no others); a null leaves the feature out. Cast dates and decimals before.

    Each task writes files of its own names; the manifest, written last by one task, names those that count, so files of lost attempts are never read. A folder is written once.
    """
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType, T.StringType)}
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    if wrong := sorted(name for name, kind in kinds.items() if not kind):
        raise ValueError(f"columns that an Example can't hold: {', '.join(wrong)}")

    columns = [(name, kind, name in arrays, name in texts) for name, kind in kinds.items()]

    def message(row: tuple) -> bytes:
        features = {}
        for (name, kind, array, text), value in zip(columns, row):
            if value is None:
                continue
            values = value if array else [value]
            if array and None in values:
                raise ValueError(f"{name}: a null in an array")
            features[name] = kind, [v.encode() for v in values] if text else values
        return encode(features)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        out, name, rows, size, cuts, done = None, "", 0, 0, [], []
        records = (r for batch in batches for start in range(0, batch.num_rows, 512) for r in frames_of([message(row) for row in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns))]))
        for record in records:
            if out is None:
                name, rows, size, cuts = f"records-{uuid.uuid4().hex}.tfrecord", 0, 0, [0]
                out = store.open_output_stream(f"{folder}/{name}")
            out.write(record)
            if size - cuts[-1] >= bytes_a_task:
                cuts.append(size)
            rows, size = rows + 1, size + len(record)
            if size >= bytes_a_file:
                out.close()
                done.append((name, rows, size, cuts))
                out = None
        if out is not None:
            out.close()
            done.append((name, rows, size, cuts))
        yield pa.RecordBatch.from_pydict({"file": pa.array([d[0] for d in done], pa.string()), "rows": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64()), "cuts": pa.array([d[3] for d in done], pa.list_(pa.int64()))})

    files = df.mapInArrow(write, "file string, rows long, bytes long, cuts array<long>")
    stream_lines(files, F.to_json(F.struct("file", "rows", "bytes", "cuts")), F.col("file"), f"{root.rstrip('/')}/manifest.jsonl", tail="\n")


# ---- reading


@dataclass
class RecordFile(InputPartition):
    """A file, or a stretch of it in which records begin."""

    path: str
    bytes: int | None = None  # of the file, as the manifest says
    start: int = 0
    end: int | None = None  # where the next stretch begins


def record_files(root: str, split: str = "") -> list[RecordFile]:
    """Files that the manifest names; without a manifest those whose names hold ``.tfrecord``, of one split (``...-train.tfrecord-00000-of-00008``) if asked for."""
    import json

    from pyarrow import fs

    store, folder = open_store(root)
    base = root.rstrip("/")
    if store.get_file_info(f"{folder}/manifest.jsonl").type == fs.FileType.File:
        with store.open_input_stream(f"{folder}/manifest.jsonl") as file:
            said = [json.loads(line) for line in file.read().decode().splitlines() if line]
        return [RecordFile(f"{base}/{s['file']}", s["bytes"], a, z) for s in said for a, z in zip(s["cuts"], [*s["cuts"][1:], None])]
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith("."))
    return [RecordFile(f"{base}/{n}") for n in names if ".tfrecord" in n and (not split or f"-{split}.tfrecord" in n)]


def scan(part: RecordFile) -> Iterator[list[tuple[int, bytes | None, str | None]]]:
    """Batches of position, message and reason."""
    from pyarrow import fs

    store, path = open_store(part.path)
    if store.get_file_info(path).type != fs.FileType.File:
        yield [(part.start, None, "missing file")]
        return
    with store.open_input_file(path) as source:
        size = source.size()
        if part.start > size:
            yield [(part.start, None, "another size than the manifest says")]
            return
        file = pa.BufferedInputStream(source.get_stream(part.start, size - part.start), READ)
        at, more = part.start, True
        while more:
            heads, sums, held, size, end = [], [], [], 0, None
            while size < BYTES_A_BATCH and len(held) < ROWS_A_BATCH:
                if part.end is not None and at >= part.end:
                    more = False
                    break
                head = file.read(12)
                if len(head) < 12:
                    end = "a frame that is cut off" if head else "another size than the manifest says" if part.bytes not in (None, at) else None
                    more = False
                    break
                length = struct.unpack_from("<Q", head)[0]
                # one length is checked at once if a large read hangs on it, the others with their batch
                if length > READ and masked_sums([head[:8]])[0] != struct.unpack_from("<I", head, 8)[0] or length > LONGEST:
                    end, more = "another checksum of the length", False
                    break
                body = file.read(length + 4)
                heads.append(head)
                held.append((at, body[:length] if len(body) == length + 4 else None))
                sums.append(body[length:])
                at, size = at + 12 + len(body), size + len(body)
            right = masked_sums([h[:8] for h in heads]) == np.array([struct.unpack_from("<I", h, 8)[0] for h in heads], np.uint32)
            if not right.all():  # what follows a wrong length isn't known to be a frame
                first = int(np.argmin(right))
                at, end, more = held[first][0], "another checksum of the length", False
                held, sums = held[:first], sums[:first]
            elif held and held[-1][1] is None:
                at, end, more = held[-1][0], "a frame that is cut off", False
                held, sums = held[:-1], sums[:-1]
            same = masked_sums([m for _, m in held]) == np.array([struct.unpack("<I", s)[0] for s in sums], np.uint32)
            rows = [(place, message if ok else None, None if ok else "another checksum of the message") for (place, message), ok in zip(held, same.tolist())]
            yield rows + ([(at, None, end)] if end else [])


def _fit(name: str, column: T.DataType, feature: tuple[str, list] | None):
    if feature is None:
        return None
    kind, values = feature
    single = column.elementType if isinstance(column, T.ArrayType) else column
    if kind != kind_of(column) and values:
        raise BadMessage(f"{name}: a list of {kind}")
    if isinstance(single, T.StringType):
        try:
            values = [v.decode() for v in values]
        except UnicodeDecodeError as reason:
            raise BadMessage(f"{name}: bytes that aren't text") from reason
    elif isinstance(single, T.BooleanType):
        values = [v != 0 for v in values]
    elif kind == "int" and values:
        bits = {T.IntegerType: 31, T.ShortType: 15, T.ByteType: 7}.get(type(single), 63)
        if min(values) < -(1 << bits) or max(values) >= 1 << bits:
            raise BadMessage(f"{name}: a number that doesn't fit")
    if isinstance(column, T.ArrayType):
        return values
    if len(values) > 1:
        raise BadMessage(f"{name}: {len(values)} values")
    return values[0] if values else None


class RecordFiles(DataSource):
    """``spark.read.format("record_files").schema(...)``; options: path, split. Columns are features by name; ``file``, ``position`` and ``reason`` say where a row stands and why it couldn't be read (then its features are null).

    Without a schema, the features of the first record, as arrays."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> T.StructType:
        kinds = {"bytes": T.BinaryType(), "float": T.FloatType(), "int": T.LongType()}
        for part in record_files(self.options["path"], self.options.get("split", "")):
            for batch in scan(part):
                for _, message, _ in batch:
                    if message is not None:
                        found = decode(message)
                        return T.StructType([*[T.StructField(n, T.ArrayType(kinds[k])) for n, (k, _) in sorted(found.items())], *[T.StructField(n, t) for n, t in WHERE.items()]])
        raise ValueError(f"no record in {self.options['path']} tells a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("split", ""), schema)


WHERE = {"file": T.StringType(), "position": T.LongType(), "reason": T.StringType()}


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: str, schema: T.StructType):
        self.path, self.split, self.wanted = path, split, schema

    def partitions(self):
        return record_files(self.path, self.split)

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = {f.name: f.dataType for f in self.wanted.fields if f.name not in WHERE}
        if wrong := sorted(n for n, t in columns.items() if not kind_of(t)):
            raise ValueError(f"columns that an Example can't hold: {', '.join(wrong)}")
        names, shape = set(columns), to_arrow_schema(self.wanted)
        for batch in scan(partition) if partition else ():
            out: dict[str, list] = {name: [] for name in self.wanted.names}
            for position, message, reason in batch:
                row: dict = {}
                if message is not None:
                    try:
                        found = decode(message, names)
                        row = {name: _fit(name, kind, found.get(name)) for name, kind in columns.items()}
                    except BadMessage as wrong:
                        row, reason = {}, str(wrong)
                row |= {"file": os.path.basename(partition.path), "position": position, "reason": reason}
                for name, values in out.items():
                    values.append(row.get(name))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in shape], schema=shape)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordFiles)
