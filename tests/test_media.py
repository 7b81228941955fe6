"""Files of boxes: written by tasks, checked, and every kind of damage a reason."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import media as M


def build(sizes=(5, 7, 9), ticks=(40, 40, 80), **other):
    sizes, ticks = np.array(sizes, np.int64), np.array(ticks, np.int64)
    head = M.box("ftyp", b"isom", bytes(4), b"isom")
    content = struct.pack(">I4sQ", 1, b"mdat", 16 + int(sizes.sum())) + bytes(int(sizes.sum()))
    said = {"scale": 1000, "start": len(head) + 16, "codec": "avc1", "width": 64, "height": 48, **other}
    return head + content + M.movie(sizes, ticks, **said)


def check(tmp_path, data):
    path = tmp_path / "file.mp4"
    path.write_bytes(data)
    return M.check_file(str(path))


def error(tmp_path, data):
    row = check(tmp_path, data)
    assert row["ok"] == (row["error"] is None)
    return row["error"]


def test_good_file(tmp_path):
    data = build()
    assert check(tmp_path, data) == {"path": str(tmp_path / "file.mp4"), "ok": True, "size": len(data), "duration": 0.16, "error": None, "codec": "avc1", "width": 64, "height": 48, "frames": 3}


def test_missing_and_empty(tmp_path):
    assert M.check_file(str(tmp_path / "none.mp4"))["error"] == "missing" and M.check_file(str(tmp_path))["error"] == "missing"
    assert error(tmp_path, b"") == "empty"


def test_every_cut_is_found(tmp_path):
    data = build()
    for n in range(1, len(data)):
        assert error(tmp_path, data[:n]) is not None, n
    for tail in (b"\0", b"\0" * 7, b"\0\0\0\1free"):
        assert error(tmp_path, data + tail) is not None
    assert error(tmp_path, data + b"\0\0\0\x08free") is None and error(tmp_path, data + b"\0\0\0\0free12345") is None


def test_no_flipped_byte_ends_the_check(tmp_path):
    data = build(sizes=range(1, 30), ticks=[40] * 29)
    for at in range(len(data)):
        flipped = bytearray(data)
        flipped[at] ^= 0xFF
        row = check(tmp_path, bytes(flipped))
        assert row["ok"] == (row["error"] is None)


def put(data, kind, at, value, width=4):
    """A number at a place of a box's content."""
    place = data.index(kind.encode()) + 4 + at
    return data[:place] + value.to_bytes(width, "big") + data[place + width :]


def test_reasons(tmp_path):
    data = build()
    assert error(tmp_path, build(handler="soun")) == "no video stream"
    assert error(tmp_path, build(sizes=(), ticks=())) == "no frames"
    assert error(tmp_path, put(data, "stsz", 8, 4)) == "stsz counts 4 entries in 12 bytes"
    assert error(tmp_path, put(data, "stts", 8, 9)) == "times of 10 samples, sizes of 3"
    assert error(tmp_path, put(data, "stts", 12, 50)) == "samples take 0.18 seconds, the track 0.16"
    assert error(tmp_path, put(data, "stsc", 12, 2)) == "chunks of 2 samples, sizes of 3"
    assert error(tmp_path, put(data, "stsc", 8, 2)) == "runs of chunks out of order"
    assert error(tmp_path, put(data, "co64", 8, len(data) - 20, 8)) == "chunk 0 lies outside the file"
    assert error(tmp_path, put(data, "co64", 8, (1 << 64) - 1, 8)) == "chunk 0 lies outside the file"
    assert error(tmp_path, put(data, "stts", 8, 0xFFFFFFFF)) == "times of more samples than can be"
    assert error(tmp_path, put(data, "mvhd", 20, 0)) == "mvhd without a time scale"
    assert error(tmp_path, put(data, "mvhd", 0, 7, 1)).startswith("mvhd of version 7")
    assert error(tmp_path, data.replace(b"stbl", b"stbx")) == "no stbl box in minf"
    assert error(tmp_path, data.replace(b"ftyp", b"free")) == "no ftyp box at the start"
    assert error(tmp_path, data + data[data.index(b"moov") - 4 :]) == "2 moov boxes in file"
    assert error(tmp_path, data + M.box("moof")) == "fragmented"
    assert error(tmp_path, put(data, "mdia", -8, 4)) == f"mdia at {data.index(b'mdia') - 4} says 4 bytes"


def test_boxes_nested_without_end(tmp_path):
    deep = b""
    for _ in range(5000):
        deep = M.box("moov", deep)
    assert error(tmp_path, M.box("ftyp", bytes(12)) + deep) == "no video stream"


def test_samples_of_one_size_in_short_chunk_tables(tmp_path):
    """The other forms of the tables: one size for all, several chunks of several samples, 32-bit places."""
    zero = bytes(4)

    def table(firsts, count=10, places=(20, 60, 100), size=4):
        stsc = b"".join(struct.pack(">III", a, n, 1) for a, n in firsts)
        return M.box("stbl", M.box("stsd", zero, struct.pack(">I", 1), M.box("mp4v", bytes(24), struct.pack(">HH", 8, 8), bytes(50))), M.box("stts", zero, struct.pack(">III", 1, count, 2)), M.box("stsc", zero, struct.pack(">I", len(firsts)), stsc), M.box("stsz", zero, struct.pack(">II", size, count)), M.box("stco", zero, struct.pack(f">I{len(places)}I", len(places), *places)))

    def file(stbl, length=20):
        clock = zero + bytes(8) + struct.pack(">II", 10, length)
        moov = M.box("moov", M.box("mvhd", clock, bytes(80)), M.box("trak", M.box("mdia", M.box("mdhd", clock, zero), M.box("hdlr", zero, zero, b"vide", bytes(13)), M.box("minf", stbl))))
        return M.box("ftyp", bytes(12)) + M.box("mdat", bytes(100)) + moov

    row = check(tmp_path, file(table([(1, 4), (3, 2)])))
    assert row["ok"] and row["frames"] == 10 and row["duration"] == 2.0 and row["codec"] == "mp4v"
    assert error(tmp_path, file(table([(1, 4), (2, 2)]))) == "chunks of 8 samples, sizes of 10"
    assert error(tmp_path, file(table([(1, 4), (3, 2)], places=(20, 60, 100000)))) == "chunk 2 lies outside the file"
    assert error(tmp_path, file(table([(1, 4), (3, 2)], size=1 << 31))) == "samples larger than the file"
    assert error(tmp_path, file(table([(1, 0), (3, 2)]))) == "runs of chunks out of order"


def test_many_samples_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 256)
    rng = np.random.default_rng(1)
    sizes, ticks = rng.integers(0, 9, 1000), rng.integers(1, 4, 1000)
    row = check(tmp_path, build(sizes, ticks))
    assert row["ok"] and row["frames"] == 1000 and row["duration"] == ticks.sum() / 1000


def test_written_and_checked(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 7).alias("e"), "id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("frame "), "id")).alias("data"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("lasts"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS e, 1000L AS id, 'x' AS data, 1L AS lasts"))
    files = M.write_media(rows, str(tmp_path / "videos"), "e", ["id"], "data", "lasts", 1000, "test", 3, 2)
    assert sorted(f.name for f in (tmp_path / "videos").glob("*.mp4")) == [f"episode_{e:06d}.mp4" for e in range(7)]
    found = {r.episode_index: r for r in M.check_media(files).collect()}
    for e in range(7):
        ids = range(e, 400, 7)
        r, content = found[e], (tmp_path / "videos" / f"episode_{e:06d}.mp4").read_bytes()
        assert (r.ok, r.error, r.frames, r.codec, r.width, r.height, r.size) == (True, None, len(ids), "test", 3, 2, len(content))
        assert r.duration == sum(i for i in ids if i % 3) / 1000 and "".join(f"frame {i}" for i in ids if i % 5).encode() in content
    (tmp_path / "videos" / "episode_000004.mp4").write_bytes(b"")
    asked = files.unionByName(spark.sql("SELECT 4L AS episode_index, CAST(NULL AS STRING) AS path"))
    assert M.media_report(M.check_media(asked)).first().asDict() == {"videos_checked": 8, "bad_videos": 2, "bad_episodes": 1, "ok": False}
    assert M.media_report(M.check_media(asked.where("episode_index > 99"))).first().asDict() == {"videos_checked": 0, "bad_videos": 0, "bad_episodes": 0, "ok": True}
    with pytest.raises(ValueError, match="size"):
        M.check_media(files.withColumn("size", F.lit(1)))
