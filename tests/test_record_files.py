"""Record files: checksums against a plain loop, messages, round trips, and damage as rows."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.sources import record_files as R

SCHEMA = "id long, name string, x float, flags array<boolean>, v array<float>, raw binary, file string, position long, reason string"


def plain_sum(data: bytes) -> int:
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (R.POLYNOMIAL if state & 1 else 0)
    state ^= 0xFFFFFFFF
    return ((state >> 15 | state << 17) + R.MASK) & 0xFFFFFFFF


def test_known_checksum():
    # the check value of CRC-32C, masked
    assert R.masked_sums([b"123456789"])[0] == ((0xE3069283 >> 15 | 0xE3069283 << 17) + R.MASK) & 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8))
def test_checksums(records):
    records = [*records, b"\0" * 64, b"\0" * 65, b"", b"\xff" * 191]
    assert R.masked_sums(records).tolist() == [plain_sum(r) for r in records]


def test_empty_and_long():
    assert R.masked_sums([]).tolist() == []
    long = bytes(range(251)) * 300
    assert R.masked_sums([b"a", long, b""]).tolist() == [plain_sum(b"a"), plain_sum(long), plain_sum(b"")]


VALUES = st.one_of(
    st.tuples(st.just("bytes"), st.lists(st.binary(max_size=40), max_size=4)),
    st.tuples(st.just("float"), st.lists(st.floats(width=32, allow_nan=False), max_size=4)),
    st.tuples(st.just("int"), st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=4)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=5), VALUES, max_size=4))
def test_messages(features):
    assert R.decode(R.encode(features)) == features
    assert R.decode(R.encode(features), {"a"}) == {k: v for k, v in features.items() if k == "a"}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_are_a_message_or_refused(data):
    try:
        R.decode(data)
    except R.BadMessage:
        pass


def test_unpacked_values_unknown_fields_and_repeated_names():
    number, one = R._field(1, b"n") + R._field(2, R._field(3, b"\x08\x05\x08\x07")), R._field(1, b"x") + R._field(2, R._field(2, b"\x0d" + struct.pack("<f", 1.5)))
    again = R._field(1, b"n") + R._field(2, R._field(3, R._field(1, b"\x09")))
    message = R._field(9, b"what") + b"\x58\x01" + R._field(1, R._field(1, number) + R._field(1, one))
    assert R.decode(message) == {"n": ("int", [5, 7]), "x": ("float", [1.5])}
    assert R.decode(message + R._field(1, R._field(1, again))) == {"n": ("int", [9]), "x": ("float", [1.5])}


@pytest.fixture
def root(spark, tmp_path):
    R.register(spark)
    i = F.col("id")
    df = spark.range(300).select("id", F.when(i % 7 != 0, F.concat(F.lit("näme "), i)).alias("name"), (i / 4).cast("float").alias("x"), F.when(i % 5 == 0, F.array()).otherwise(F.array(i % 2 == 0, i % 3 == 0)).cast("array<boolean>").alias("flags"), F.array(i.cast("float"), F.lit(-1.0).cast("float")).alias("v"), F.when(i > 3, i.cast("string").cast("binary")).alias("raw"))
    path = str(tmp_path / "records")
    R.write_records(df.repartition(2), path, 4000, 1 << 20)
    return path, {r.id: r for r in df.collect()}


def load(spark, path, schema=SCHEMA, **options):
    reader = spark.read.format("record_files").option("path", path).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def files(path):
    from pathlib import Path

    return sorted(Path(path).glob("*.tfrecord*"))


def test_round_trip(spark, root):
    path, want = root
    rows = load(spark, path).collect()
    assert len(files(path)) > 2 and {r.id: (r.name, r.x, r.flags, r.v, r.raw) for r in rows} == {i: (r.name, r.x, r.flags, r.v, r.raw) for i, r in want.items()}
    assert len(rows) == 300 and all(r.reason is None and r.file.endswith(".tfrecord") for r in rows) and len({(r.file, r.position) for r in rows}) == 300
    assert load(spark, path, "x float").agg(F.count("x")).first()[0] == 300
    told = load(spark, path, None)
    assert told.schema["id"].dataType.simpleString() == "array<bigint>" and sorted(r.id[0] for r in told.collect()) == list(range(300))


def test_stretches_of_files(spark, root, tmp_path):
    _, want = root
    path, df = str(tmp_path / "cut"), spark.range(300).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("name"))
    R.write_records(df.coalesce(1), path, bytes_a_task=2000)
    parts, content = R.record_files(path), files(path)[0].read_bytes()
    assert len(files(path)) == 1 and len(parts) > 10 and [p.end for p in parts[:-1]] == [p.start for p in parts[1:]] and parts[-1].end is None
    rows = load(spark, path, "id long, name string, position long, reason string")
    assert sorted((r.id, len(r.name), r.reason) for r in rows.collect()) == [(i, i, None) for i in range(300)]
    places = {r.position: r.id for r in rows.collect()}
    # a wrong length hides what follows it in its stretch only
    flipped, third = bytearray(content), parts[2]
    flipped[third.start] ^= 1
    files(path)[0].write_bytes(bytes(flipped))
    lost = {i for p, i in places.items() if third.start <= p < third.end}
    assert {r.id for r in rows.collect()} - {None} == set(range(300)) - lost and [(r.position, r.reason) for r in rows.where("reason IS NOT NULL").collect()] == [(third.start, "another checksum of the length")]
    # a record that ends behind its stretch's end, and a file that ends before a stretch begins
    files(path)[0].write_bytes(content[: third.start - 1])
    assert {r.reason for r in rows.where("reason IS NOT NULL").collect()} == {"a frame that is cut off", "another size than the manifest says"}


def test_files_that_no_manifest_names_are_not_read(spark, root):
    path, _ = root
    (files(path)[0].parent / "records-lost.tfrecord").write_bytes(files(path)[0].read_bytes())
    assert load(spark, path).count() == 300


def test_damage(spark, root):
    path, want = root
    first = files(path)[0]
    content = first.read_bytes()
    size = struct.unpack_from("<Q", content)[0]
    there = sorted((r.position, r.id) for r in load(spark, path).where(F.col("file") == first.name).collect())
    second = there[1][0]
    assert second == size + 16

    def read(data):
        first.write_bytes(data)
        rows = load(spark, path).where(F.col("file") == first.name).orderBy("position").collect()
        return [(r.position, r.id, r.reason) for r in rows]

    good = [(p, i, None) for p, i in there]
    flipped = bytearray(content)
    flipped[20] ^= 4
    assert read(bytes(flipped)) == [(0, None, "another checksum of the message"), *good[1:]]
    flipped = bytearray(content)
    flipped[second] ^= 1
    assert read(bytes(flipped)) == [good[0], (second, None, "another checksum of the length")]
    flipped[second + 7] = 127  # a length that nothing can hold
    assert read(bytes(flipped)) == [good[0], (second, None, "another checksum of the length")]
    assert read(content[:-2]) == [*good[:-1], (there[-1][0], None, "a frame that is cut off")]
    assert read(content + b"abc") == [*good, (len(content), None, "a frame that is cut off")]
    assert read(content[:second]) == [good[0], (second, None, "another size than the manifest says")]
    first.unlink()
    assert [(r.file, r.reason) for r in load(spark, path).where("reason IS NOT NULL").collect()] == [(first.name, "missing file")]


def test_other_kinds_are_reasons(spark, root):
    path, _ = root
    for schema, reason in (("id string", "id: a list of int"), ("v float", "v: 2 values"), ("raw array<long>", "raw: a list of bytes"), ("id byte", "id: a number that doesn't fit")):
        found = load(spark, path, f"{schema}, reason string").where("reason IS NOT NULL").select("reason").distinct().collect()
        assert [r.reason for r in found] == [reason]
    assert load(spark, path, "nothing string, reason string").where("nothing IS NOT NULL OR reason IS NOT NULL").count() == 0


def test_splits_without_a_manifest(spark, tmp_path):
    R.register(spark)
    for name, ids in (("toy-train.tfrecord-00000-of-00002", [1, 2]), ("toy-train.tfrecord-00001-of-00002", []), ("toy-test.tfrecord-00000-of-00001", [3])):
        (tmp_path / name).write_bytes(b"".join(R.frames_of([R.encode({"id": ("int", [i]), "name": ("bytes", [b"\xff"] if i == 2 else [b"ok"])}) for i in ids] + [b"\x07" for i in ids if i == 3])))
    (tmp_path / "dataset_info.json").write_text("{}")
    rows = load(spark, str(tmp_path), "id long, name string, reason string")
    assert sorted((str(r.id), r.name, r.reason) for r in rows.collect()) == [("1", "ok", None), ("3", "ok", None), ("None", None, "a field of wire type 7"), ("None", None, "name: bytes that aren't text")]
    assert [r.id for r in load(spark, str(tmp_path), "id long", split="train").collect()] == [1, 2]


def test_what_is_not_written(spark, tmp_path):
    R.register(spark)
    with pytest.raises(ValueError, match="can't hold: d, m"):
        R.write_records(spark.sql("SELECT 1 AS a, current_date() AS d, map(1, 2) AS m"), str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="a null in an array"):
        R.write_records(spark.sql("SELECT array(1, null) AS a"), str(tmp_path / "null"))
    R.write_records(spark.sql("SELECT 1 AS a").where("a > 1"), str(tmp_path / "empty"))
    assert load(spark, str(tmp_path / "empty"), "a long").count() == 0
    assert np.isnan(R.decode(R.encode({"x": ("float", [float("nan")])}))["x"][1][0])
