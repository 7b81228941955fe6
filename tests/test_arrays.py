"""Shards of arrays: written and read by range, headers as numpy writes them, and damaged files refused."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import arrays as A


@pytest.fixture
def root(spark, tmp_path):
    A.register(spark)
    df = spark.range(95).select(F.col("id").alias("i"), F.array(F.col("id").cast("float"), (F.col("id") * 2).cast("float")).alias("v"), (F.col("id") % 3 == 0).alias("flag"), (F.col("id") * 10).alias("big"), (F.col("id") / 4).alias("x"))
    path = str(tmp_path / "shards")
    assert A.write_arrays(df.repartition(4), path, "i", ["v", "flag", "big", "x"], 20) == 95
    return path


def load(spark, path, **options):
    return spark.read.format("array_shards").option("path", path).options(**options).load()


def test_numpy_reads_what_is_written(root, tmp_path):
    folders = sorted(p.name for p in (tmp_path / "shards").iterdir())
    assert folders == [f"shard-{s:020d}" for s in (0, 20, 40, 60, 80)]
    last = tmp_path / "shards" / folders[-1]
    assert np.load(last / "v.npy").tolist() == [[float(i), 2.0 * i] for i in range(80, 95)] and np.load(last / "flag.npy").tolist() == [i % 3 == 0 for i in range(80, 95)]
    assert np.load(last / "v.npy").dtype == np.float32


@pytest.mark.parametrize("values", [np.zeros((3, 4), "<f4"), np.arange(5), np.zeros((0, 2)), np.array([True]), np.zeros((2, 3, 4), np.uint8)])
def test_headers_of_numpy(values):
    out = io.BytesIO()
    np.save(out, values)
    descr, shape, begin = A.parse_header(out.getvalue())
    assert (descr, shape) == (values.dtype.str, values.shape) and out.getvalue()[begin:] == values.tobytes()
    assert np.load(io.BytesIO(A.header(descr, shape) + values.tobytes())).tolist() == values.tolist() and len(A.header(descr, shape)) % 64 == 0


@pytest.mark.parametrize("data", [b"", b"\x93NUMPY", b"\x93NUMPY\x01\x00\xff\xff{}", b"PK" * 40, A.header("<f4", (2,)).replace(b"False", b"True "), A.header("<f4", (2,)).replace(b"<f4", b"<c8"), A.header("<f4", (2,)).replace(b"(2,)", b"(-2)"), A.header("<f4", (2,)).replace(b"{", b"["), A.header("<f4", (2,)).replace(b"\x01\x00", b"\x09\x00", 1)])
def test_headers_that_are_refused(data):
    with pytest.raises(A.BrokenShard):
        A.parse_header(data)


def test_ranges(spark, root):
    df = load(spark, root)
    rows = df.orderBy("index").collect()
    assert [(r["index"], r.big, r.flag, r.v, r.x) for r in rows] == [(i, 10 * i, i % 3 == 0, [float(i), 2.0 * i], i / 4) for i in range(95)]
    for condition, want in (("index >= 15 AND index < 45", range(15, 45)), ("index > 90", range(91, 95)), ("index <= 3", range(4)), ("index = 41", [41]), ("index >= 200", []), ("index >= 10 AND flag", [i for i in range(10, 95) if i % 3 == 0])):
        found = df.where(condition)
        assert sorted(r["index"] for r in found.collect()) == list(want), condition
    assert load(spark, root, columns="big").columns == ["index", "big"]
    reader = A._Reader(root, ["big"], True)
    assert list(reader.pushFilters([A.GreaterThanOrEqual(("index",), 15), A.LessThan(("index",), 45), A.LessThan(("big",), 3)])) == [A.LessThan(("big",), 3)]
    assert [(p.said["start"], p.start, p.end) for p in reader.partitions()] == [(0, 15, 20), (20, 0, 20), (40, 0, 5)]


def test_damaged_shards_are_refused(spark, root, tmp_path):
    at = tmp_path / "shards" / f"shard-{20:020d}" / "v.npy"
    content = at.read_bytes()
    flipped = bytearray(content)
    flipped[-3] ^= 1
    at.write_bytes(bytes(flipped))
    with pytest.raises(Exception, match="another digest"):
        load(spark, root).collect()
    assert load(spark, root, verify="false").count() == 95 and load(spark, root, columns="big").count() == 95
    assert load(spark, root).where("index >= 40").count() == 55  # other shards are not touched
    for wrong in (content[:-4], content + b"\0", A.header("<f4", (20, 1)) + content[-160:]):
        at.write_bytes(wrong)
        with pytest.raises(Exception, match="v.npy"):
            load(spark, root, verify="false").collect()
    at.write_bytes(content)
    manifest = at.parent / "manifest.json"
    manifest.write_text(json.dumps({**json.loads(manifest.read_text()), "rows": 19}))
    with pytest.raises(Exception, match="after row"):
        load(spark, root).collect()


def test_what_is_not_written(spark, tmp_path):
    path = str(tmp_path / "wrong")
    one = spark.range(4)
    for df in (one.where("id <> 2"), one.unionByName(one), one.withColumn("v", F.when(F.col("id") > 0, 1))):
        with pytest.raises(Exception, match="gaps|null"):
            A.write_arrays(df.withColumn("v", F.col("v") if "v" in df.columns else F.lit(1)), path, "id", ["v"])
    for v in (F.array_repeat(F.lit(1), F.col("id").cast("int")), F.lit("text"), F.array(F.lit(None).cast("int"))):
        with pytest.raises(Exception, match="v: "):
            A.write_arrays(one.withColumn("v", v), path, "id", ["v"])
    assert A.write_arrays(one.limit(0), path, "id", ["id"]) == 0
