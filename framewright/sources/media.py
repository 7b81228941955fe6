"""Episode videos as files of nested boxes: checked without decoding, by reading the boxes that describe the media and passing over the media itself.

A file is good if its boxes fill it, a video track says how its samples lie in time and in the file, these tables agree with each other, and every sample lies inside the file. What is wrong first is the row's ``error``; a damaged
file never ends a task. A table must fill its box before it is read, so a wrong count takes no memory; a video's samples take at most 8 bytes each. Fragmented files describe their samples elsewhere and are reported as such.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.sources.commits import open_store
from framewright.sources.filesystem import stored

PIECE = 1 << 20
FOUND = "path string, ok boolean, size long, duration double, error string, codec string, width int, height int, frames long"
# Fixed values of the format: boxes that hold boxes on the way to the tables of samples, and where they stand.
NESTED = {"moov": "file", "trak": "moov", "mdia": "trak", "minf": "mdia", "stbl": "minf"}


class BadMedia(ValueError):
    """The first thing that is wrong with a file."""


@dataclass
class Box:
    kind: str
    begin: int  # of the content
    end: int
    inside: list[Box] = field(default_factory=list)

    def all(self, kind: str) -> list[Box]:
        return [b for b in self.inside if b.kind == kind]

    def one(self, *path: str) -> Box:
        at = self
        for kind in path:
            found = at.all(kind)
            if len(found) != 1:
                raise BadMedia(f"{len(found)} {kind} boxes in {at.kind}" if found else f"no {kind} box in {at.kind}")
            at = found[0]
        return at


# ---- reading


def _read(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise BadMedia(f"the file ends inside {n} bytes at {at}")
    return data


def boxes(file, begin: int, end: int, parent: str) -> Iterator[Box]:
    """Boxes of a stretch, one behind the other; each must lie inside it."""
    at = begin
    while at < end:
        if end - at < 8:
            raise BadMedia(f"{end - at} bytes behind the last box in {parent}")
        size, kind = struct.unpack(">I4s", _read(file, at, 8))
        name, start = kind.decode("latin1"), at + 8
        if size == 1:
            if end - at < 16:
                raise BadMedia(f"{name} at {at} is cut off")
            size, start = struct.unpack(">Q", _read(file, at + 8, 8))[0], at + 16
        elif size == 0 and parent == "file":
            size = end - at  # up to the end
        if size < start - at:
            raise BadMedia(f"{name} at {at} says {size} bytes")
        if at + size > end:
            raise BadMedia(f"{name} at {at} ends {at + size - end} bytes behind {parent}")
        box = Box(name, start, at + size)
        if NESTED.get(name) == parent:  # elsewhere they count for nothing, however deep they lie
            box.inside = list(boxes(file, start, box.end, name))
        yield box
        at += size


def _table(file, box: Box, head: int, width: int) -> tuple[int, bytes]:
    """Number of entries of a table whose count stands behind ``head`` bytes, which must fill the box, and those bytes."""
    if box.end - box.begin < head + 4:
        raise BadMedia(f"{box.kind} is cut off")
    data = _read(file, box.begin, head + 4)
    n = struct.unpack_from(">I", data, head)[0]
    if width and box.begin + head + 4 + n * width != box.end:
        raise BadMedia(f"{box.kind} counts {n} entries in {box.end - box.begin - head - 4} bytes")
    return n, data


def _entries(file, box: Box, head: int, columns: int, n: int, kind: str = ">u4") -> Iterator[np.ndarray]:
    """Entries in pieces of whole rows."""
    width, at = np.dtype(kind).itemsize * columns, box.begin + head + 4
    rows = PIECE // width
    for start in range(0, n, rows):
        m = min(rows, n - start)
        yield np.frombuffer(_read(file, at + start * width, m * width), kind).reshape(m, columns).astype(np.int64)


def _clock(file, box: Box) -> tuple[int, int]:
    """Ticks a second and length in ticks of a header of a movie or a track's media."""
    version = _read(file, box.begin, 1)[0] if box.end > box.begin else 255
    need = {0: 20, 1: 32}.get(version)
    if need is None or box.end - box.begin < need:
        raise BadMedia(f"{box.kind} of version {version} and {box.end - box.begin} bytes")
    scale, length = struct.unpack_from(">II" if version == 0 else ">IQ", _read(file, box.begin, need), 12 if version == 0 else 20)
    if not scale:
        raise BadMedia(f"{box.kind} without a time scale")
    return scale, length


def _handler(file, track: Box) -> str:
    box = track.one("mdia", "hdlr")
    return _read(file, box.begin + 8, 4).decode("latin1") if box.end - box.begin >= 12 else ""


def _samples(file, table: Box, size: int) -> tuple[int, int]:
    """Number and ticks of a track's samples, once its tables agree and all samples lie inside the file."""
    stts, stsc = table.one("stts"), table.one("stsc")
    n, _ = _table(file, stts, 4, 8)
    timed = ticks = 0
    for rows in _entries(file, stts, 4, 2, n):
        timed += int(rows[:, 0].sum())
        if timed >= 1 << 32:
            raise BadMedia("times of more samples than can be")
        ticks += (int((rows[:, 0] * (rows[:, 1] >> 16)).sum()) << 16) + int((rows[:, 0] * (rows[:, 1] & 0xFFFF)).sum())
    stsz = table.one("stsz")
    count, data = _table(file, stsz, 8, 0)
    fixed = struct.unpack_from(">I", data, 4)[0]
    if not fixed:
        _table(file, stsz, 8, 4)
    if timed != count:
        raise BadMedia(f"times of {timed} samples, sizes of {count}")
    if not count:
        raise BadMedia("no frames")
    if fixed * count > size:
        raise BadMedia("samples larger than the file")
    wide = not table.all("stco")
    places = table.one("co64" if wide else "stco")
    chunks, _ = _table(file, places, 4, 8 if wide else 4)
    runs, _ = _table(file, stsc, 4, 12)
    if not runs or not chunks:
        raise BadMedia("samples without chunks")
    # samples of each chunk: a run holds from its first chunk up to the next run's
    firsts = counts = np.zeros(0, np.int64)
    for rows in _entries(file, stsc, 4, 3, runs):
        firsts, counts = np.concatenate([firsts, rows[:, 0] - 1]), np.concatenate([counts, rows[:, 1]])
    if firsts[0] != 0 or (np.diff(firsts) <= 0).any() or firsts[-1] >= chunks or not counts.all():
        raise BadMedia("runs of chunks out of order")
    held = int((np.diff(np.append(firsts, chunks)) * counts).sum())
    if held != count:
        raise BadMedia(f"chunks of {held} samples, sizes of {count}")
    sizes = _entries(file, stsz, 8, 1, count) if not fixed else iter(())
    left, chunk = np.zeros(0, np.int64), 0
    for rows in _entries(file, places, 4, 1, chunks, ">u8" if wide else ">u4"):
        each = counts[np.searchsorted(firsts, np.arange(chunk, chunk + len(rows)), side="right") - 1]
        chunk += len(rows)
        if fixed:
            lengths = each * fixed
        else:
            need, have = int(each.sum()), [left]
            while sum(map(len, have)) < need:
                have.append(next(sizes)[:, 0])
            flat = np.concatenate(have)
            flat, left = flat[:need], flat[need:]
            lengths = np.add.reduceat(flat, np.cumsum(each) - each)
        # a place near 2**64 turns negative as a signed number
        wrong = (rows[:, 0] < 0) | (rows[:, 0] > size - lengths)
        if wrong.any():
            raise BadMedia(f"chunk {chunk - len(rows) + int(np.argmax(wrong))} lies outside the file")
    return count, ticks


def check_file(path: str) -> dict:
    """One row of ``FOUND``."""
    from pyarrow import fs

    row: dict = {"path": path, "ok": False, **dict.fromkeys(("size", "duration", "error", "codec", "width", "height", "frames"))}
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type != fs.FileType.File:
        return row | {"error": "missing"}
    row["size"] = info.size
    if not info.size:
        return row | {"error": "empty"}
    try:
        with store.open_input_file(at) as file:
            top = Box("file", 0, info.size)
            top.inside = list(boxes(file, 0, info.size, "file"))
            if not top.inside or top.inside[0].kind != "ftyp":
                raise BadMedia("no ftyp box at the start")
            movie = top.one("moov")
            if movie.all("mvex") or top.all("moof"):
                raise BadMedia("fragmented")
            video = next((t for t in movie.all("trak") if _handler(file, t) == "vide"), None)
            if video is None:
                raise BadMedia("no video stream")
            scale, length = _clock(file, movie.one("mvhd"))
            row["duration"] = length / scale
            table = video.one("mdia", "minf", "stbl")
            described = table.one("stsd")
            if _table(file, described, 4, 0)[0] < 1 or described.end - described.begin < 8 + 36:
                raise BadMedia("no description of the stream")
            entry = _read(file, described.begin + 8, 36)
            row["codec"], (row["width"], row["height"]) = entry[4:8].decode("latin1"), struct.unpack_from(">HH", entry, 32)
            ticks_a_second, said = _clock(file, video.one("mdia", "mdhd"))
            row["frames"], ticks = _samples(file, table, info.size)
            if ticks != said:
                raise BadMedia(f"samples take {ticks / ticks_a_second:.6g} seconds, the track {said / ticks_a_second:.6g}")
    except (BadMedia, struct.error) as reason:
        return row | {"error": str(reason)}
    return row | {"ok": True}


def check_media(expected: DataFrame) -> DataFrame:
    """``FOUND`` for every row's ``path``, and the row's other columns. Each task checks its rows' files; nothing but boxes and tables is read of them."""
    names = [f.split(" ")[0] for f in FOUND.split(", ")]
    if clash := sorted(set(expected.columns) & set(names[1:])):
        raise ValueError(f"columns named as those of the check: {', '.join(clash)}")
    rest = [c for c in expected.columns if c != "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [check_file(p) if p is not None else {"path": None, "ok": False, "error": "missing"} for p in batch.column("path").to_pylist()]
            found = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("size", pa.int64()), ("duration", pa.float64()), ("error", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *found.columns], names=[*rest, *found.schema.names])

    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in expected.schema.fields if f.name != "path"], FOUND])
    return expected.repartition("path").mapInArrow(run, shape)


def media_report(checked: DataFrame) -> DataFrame:
    """One row: videos_checked, bad_videos, bad_episodes, ok. checked: ``check_media`` of rows that have an ``episode_index``."""
    bad = ~F.col("ok")
    return checked.agg(F.count(F.lit(1)).alias("videos_checked"), F.count_if(bad).alias("bad_videos"), F.count_distinct(F.when(bad, F.col("episode_index"))).alias("bad_episodes"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))


# ---- writing


def box(kind: str, *parts: bytes) -> bytes:
    content = b"".join(parts)
    return struct.pack(">I4s", len(content) + 8, kind.encode()) + content


def movie(sizes: np.ndarray, ticks: np.ndarray, scale: int, start: int, codec: str, width: int, height: int, handler: str = "vide") -> bytes:
    """The moov box of samples that lie in one chunk from byte ``start`` on; ticks: how long each lasts."""
    whole, n = int(ticks.sum()), len(sizes)
    edges = np.flatnonzero(np.diff(ticks)) + 1
    firsts = np.concatenate([[0], edges]) if n else np.zeros(0, np.int64)
    runs = np.stack([np.diff(np.append(firsts, n)), ticks[firsts]], 1).astype(">u4").tobytes() if n else b""
    zero = bytes(4)
    entry = box(codec, bytes(6), b"\0\1", bytes(16), struct.pack(">HH", width, height), bytes(50))
    table = box("stbl", box("stsd", zero, struct.pack(">I", 1), entry), box("stts", zero, struct.pack(">I", len(firsts)), runs), box("stsc", zero, struct.pack(">IIII", 1, 1, n, 1)), box("stsz", zero, zero, struct.pack(">I", n), sizes.astype(">u4").tobytes()), box("co64", zero, struct.pack(">IQ", 1, start)))
    clock = b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", scale, whole)
    media = box("mdia", box("mdhd", clock, bytes(4)), box("hdlr", zero, zero, handler.encode(), bytes(13)), box("minf", table))
    return box("moov", box("mvhd", clock, bytes(80)), box("trak", media))


def write_media(samples: DataFrame, root: str, episode: str, order: list[str], data: str, ticks: str, scale: int = 1000, codec: str = "raw ", width: int = 0, height: int = 0) -> DataFrame:
    """One file an episode, of its rows' bytes in order; ``ticks`` is how long each row lasts (below 2**32, null: 0). Returns episode_index and path. Rows without an episode are left out.

    Rows of an episode stream through one task into its file, so that only 12 bytes a row are held; the media's size is known at the first row because it is summed before.
    """
    from pyspark.sql import Window

    total = F.sum("_size").over(Window.partitionBy("_episode"))
    rows = samples.select(F.col(episode).cast("long").alias("_episode"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(data).cast("binary").alias("_data"), F.coalesce(F.col(ticks).cast("long"), F.lit(0)).alias("_ticks")).where("_episode IS NOT NULL")
    rows = rows.withColumn("_size", F.coalesce(F.octet_length("_data"), F.lit(0)).cast("long")).withColumn("_total", total)
    rows = rows.sortWithinPartitions("_episode", *[f"_o{i}" for i in range(len(order))]).select("_episode", "_data", "_ticks", "_total")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        at, out, part, target, done, start = None, None, "", "", [], 0
        sizes: list[np.ndarray] = []
        lasts: list[np.ndarray] = []

        def close() -> None:
            out.write(movie(np.concatenate(sizes), np.concatenate(lasts), scale, start, codec, width, height))
            out.close()
            if store.get_file_info(target).type != fs.FileType.NotFound:
                store.delete_file(target)  # of an attempt of the same task
            store.move(part, target)
            done.append((at, f"{root.rstrip('/')}/{os.path.basename(target)}"))

        for batch in batches:
            keys = batch.column("_episode").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                piece = batch.slice(a, z - a)
                if keys[a] != at:
                    if out is not None:
                        close()
                    at, sizes, lasts = int(keys[a]), [], []
                    target = f"{folder}/episode_{at:06d}.mp4"
                    part = f"{folder}/.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(part)
                    head = box("ftyp", b"isom", bytes(4), b"isom")
                    out.write(head + struct.pack(">I4sQ", 1, b"mdat", 16 + piece.column("_total")[0].as_py()))
                    start = len(head) + 16
                values = [v or b"" for v in piece.column("_data").to_pylist()]
                out.write(b"".join(values))
                sizes.append(np.fromiter(map(len, values), np.int64, len(values)))
                lasts.append(piece.column("_ticks").to_numpy())
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"episode_index": pa.array([d[0] for d in done], pa.int64()), "path": pa.array([d[1] for d in done], pa.string())})

    return stored(rows.mapInArrow(write, "episode_index long, path string"), "media")
