"""Datasets on storage: what is written is read again, and a failed change leaves the former state."""

import json

import pytest
from pyspark.sql import functions as F

from framewright.operators import joins
from framewright.sources import datasets as D
from framewright.sources import episodes as E
from framewright.sources import filesystem as fs


def frames(spark, lengths, width=3):
    rows = [(e, i, [float(e + i + d) for d in range(width)], i % 3 == 0) for e, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, `observation.state` array<float>, intervention boolean").withColumn("task_index", F.lit(0).cast("long"))


def plain(df):
    return df.withColumnsRenamed({"observation.state": "state"})


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "set")
    D.write_frames(plain(frames(spark, [4, 2, 5])), path, chunk_size=2)
    D.write_metadata(spark, path, {0: "fold"}, chunk_size=2)
    return path


def test_write_then_read(spark, root, tmp_path):
    assert sorted(p.relative_to(tmp_path / "set").as_posix() for p in (tmp_path / "set/data").rglob("*.parquet")) == ["data/chunk-000/episode_000000.parquet", "data/chunk-000/episode_000001.parquet", "data/chunk-001/episode_000002.parquet"]
    rows = E.read_frames(spark, root).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(11)) and rows[5].frame_index == 1 and rows[5].timestamp == pytest.approx(1 / 30)
    assert [(r.episode_index, r.length, r.from_index, r.to_index) for r in E.read_episodes(spark, root).orderBy("episode_index").collect()] == [(0, 4, 0, 4), (1, 2, 4, 6), (2, 5, 6, 11)]
    info = E.read_info(spark, root).first()
    assert (info.total_episodes, info.total_frames, info.total_chunks, info.fps) == (3, 11, 2, 30.0)
    stats = {r["episode_index"]: r["stats"] for r in map(json.loads, (tmp_path / "set/meta/episodes_stats.jsonl").read_text().splitlines())}
    assert stats[1]["state"]["mean"] == [1.5, 2.5, 3.5] and stats[1]["state"]["count"] == [2, 2, 2]
    experts = [json.loads(x) for x in (tmp_path / "set/meta/expert_frame_index.jsonl").read_text().splitlines()]
    assert experts[0] == {"episode_index": 0, "segments": [{"start": 0, "end": 0}, {"start": 3, "end": 3}]}
    with pytest.raises(FileExistsError):
        D.write_frames(plain(frames(spark, [1])), root)


def test_append_and_remove(spark, root, tmp_path):
    D.append_episodes(plain(frames(spark, [3, 1])).drop("task_index"), root, "pour", chunk_size=2)
    got = E.read_frames(spark, root)
    assert got.count() == 15 and sorted({(r.episode_index, r.task_index) for r in got.collect()}) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)] and got.agg(F.max("index")).first()[0] == 14
    assert D.tasks_of(spark, root) == {0: "fold", 1: "pour"}
    D.remove_episodes(spark, root, [1, 3], chunk_size=2)
    left = E.read_frames(spark, root).orderBy("index").collect()
    assert [r["index"] for r in left] == list(range(10)) and [r.episode_index for r in left] == [0] * 4 + [1] * 5 + [2] and left[9].task_index == 1
    assert E.read_info(spark, root).first().total_frames == 10 and [p.name for p in (tmp_path / "set").iterdir() if p.name.startswith(".staged")] == []
    for bad in (lambda: D.append_episodes(plain(frames(spark, [3])).drop("task_index"), root, " "), lambda: D.append_episodes(plain(frames(spark, [3])).drop("task_index", "state"), root, "x"), lambda: D.append_episodes(plain(frames(spark, [3])).drop("task_index"), root, "x", fps=10.0)):
        with pytest.raises(ValueError):
            bad()
    assert E.read_frames(spark, root).count() == 10


def test_a_failed_change_is_taken_back(spark, root, tmp_path, monkeypatch):
    before = sorted((p.name, p.read_bytes()) for p in (tmp_path / "set").rglob("*") if p.is_file() and not p.name.endswith(".crc"))

    def fail(*_, **__):
        raise RuntimeError("no metadata")

    monkeypatch.setattr(D, "write_lines", fail)
    for change in (lambda: D.append_episodes(plain(frames(spark, [3])).drop("task_index"), root, "pour", chunk_size=2), lambda: D.remove_episodes(spark, root, [0], chunk_size=2)):
        with pytest.raises(RuntimeError):
            change()
        assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "set").rglob("*") if p.is_file() and not p.name.endswith(".crc")) == before


def test_merge_and_collections(spark, root, tmp_path):
    other = str(tmp_path / "other")
    D.write_frames(plain(frames(spark, [2])), other)
    D.write_metadata(spark, other, {0: "pour"})
    out = str(tmp_path / "all")
    D.merge_datasets(spark, [root, other], out)
    rows = E.read_frames(spark, out).orderBy("index").collect()
    assert len(rows) == 13 and [r["index"] for r in rows] == list(range(13)) and rows[-1].episode_index == 3 and rows[-1].task_index == 1 and D.tasks_of(spark, out) == {0: "fold", 1: "pour"}
    assert D.find_datasets(spark, root) == [root] and [p.rsplit("/", 1)[1] for p in D.find_datasets(spark, str(tmp_path))] == ["all", "other", "set"]
    assert sorted((r.dataset, r.episode_index) for r in D.read_collection(spark, str(tmp_path)).collect()) == [("all", 0), ("all", 1), ("all", 2), ("all", 3), ("other", 0), ("set", 0), ("set", 1), ("set", 2)]
    with pytest.raises(ValueError):
        D.read_collection(spark, str(tmp_path / "nothing"))
    E.read_episodes(spark, root).select("episode_index", "length").write.parquet(f"{root}/meta/episodes/chunk-000/file-000.parquet")
    assert [r.length for r in D.read_episode_files(spark, root).collect()] == [4, 2, 5]
    (tmp_path / "keep.json").write_text('{"a--0": [[0, 3], [5, 9]], "b--1": []}')
    assert [tuple(r) for r in D.read_keep_ranges(spark, str(tmp_path / "keep.json")).collect()] == [("a--0", 0, 3), ("a--0", 5, 9)]


def test_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    labels = spark.createDataFrame([(0, 1, 2), (0, 0, 1), (1, 0, None)], "episode_index long, frame_index long, label int")
    assert D.write_label_document(labels, path) == "labels.partial.json" and D.write_label_document(labels.na.fill(0), path) == "labels.json"
    assert not fs.exists(spark, f"{path}/labels.partial.json")
    assert [tuple(r) for r in E.read_tristate(spark, f"{path}/labels.json").orderBy("episode_index", "frame_index").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 0)]
    stats = spark.createDataFrame([("observation.state", [1.0, 2.0], [0.5, 0.0], [0.0, 1.0], [2.0, 3.0]), ("actions", [0.0], [1.0], None, None)], "key string, mean array<double>, std array<double>, q01 array<double>, q99 array<double>")
    D.write_norm_stats(stats, path)
    assert {r.key: (r.mean, r.std, r.q99) for r in D.read_norm_stats(spark, path).collect()} == {"state": ([1.0, 2.0], [0.5, 0.0], [2.0, 3.0]), "actions": ([0.0], [1.0], None)}
    fs.write_text(spark, f"{path}/norm_stats.json", '{"state": {"mean": [1.0], "std": [2.0]}}')
    assert D.read_norm_stats(spark, path).first().std == [2.0]
    progress = spark.createDataFrame([(0, 0.5), (1, 1.0)], "index long, progress double")
    D.write_progress(progress, f"{path}/progress.parquet", "labels", {"rows": 2})
    assert json.loads(fs.read_text(spark, f"{path}/progress.parquet.meta.json"))["progress_report"] == {"rows": 2} and E.read_progress(spark, f"{path}/progress.parquet").where("valid_label").count() == 2
    D.write_report(spark.createDataFrame([(3, None)], "kept long, note string"), f"{path}/report.json")
    assert json.loads(fs.read_text(spark, f"{path}/report.json")) == {"kept": 3, "note": None}


def test_shards_and_snapshots(spark, tmp_path):
    shard, catalog = str(tmp_path / "shard-0"), str(tmp_path / "catalog.json")
    manifest = D.publish_shard(spark.range(10).repartition(2), shard, {"reward": 1})
    assert manifest["rows"] == 10 and len(manifest["files"]) == 2 and json.loads(fs.read_text(spark, f"{shard}/manifest.json")) == manifest
    with pytest.raises(FileExistsError):
        D.publish_shard(spark.range(1), shard, {})
    D.publish_snapshot(spark, catalog, "shard-0", 10, {"reward": 1})
    assert D.publish_snapshot(spark, catalog, "shard-1", 5, {"reward": 1})[1] == {"shard": "shard-1", "start": 10, "end": 15}
    for args in (("shard-1", 5, {"reward": 1}), ("shard-2", 5, {"reward": 2})):
        with pytest.raises(ValueError):
            D.publish_snapshot(spark, catalog, *args)
    first = spark.createDataFrame(D.scan_files(spark, shard).collect())
    fs.write_text(spark, f"{shard}/more.json", "{}")
    verdicts = {r.path: r.verdict for r in joins.compare_scans(first, D.scan_files(spark, shard), "path", "state").collect()}
    assert verdicts["more.json"] == "new" and verdicts["manifest.json"] == "stable"


def test_members_in_pieces():
    import json

    document = {"a": [[1, 2]], 'quo"te \u00e9': [], "b": [[i, i + 1] for i in range(50)], "": [[0, 0]]}
    for indent in (None, 1):
        text = json.dumps(document, indent=indent) + " \n"
        for size in (1, 2, 7, 1000):
            assert dict(D.json_members(iter([text[i : i + size] for i in range(0, len(text), size)]))) == document
    assert list(D.json_members(iter(["{", " }"]))) == []
    for wrong in ("", "[]", "{", '{"a"', '{"a": [1', '{"a": [1]', '{"a": [1] "b": []}', '{"a": [1],}', '{"a": 1}', '{1: []}', "{} x", '{"a" []}', '{"a": [1]}}'):
        for size in (1, 100):
            with pytest.raises(ValueError):
                list(D.json_members(iter([wrong[i : i + size] for i in range(0, len(wrong), size)])))


def test_keep_ranges_written_and_read(spark, tmp_path, monkeypatch):
    rows = [("a--1", 5, 9), ("a--1", 0, 3), ('q"\\\u00e9', 1, 2), (None, 1, 1)]
    path = str(tmp_path / "keep.json")
    D.write_keep_ranges(spark.createDataFrame(rows, "episode_key string, start_frame int, end_frame int"), path)
    assert [tuple(r) for r in D.read_keep_ranges(spark, path).collect()] == [("a--1", 0, 3), ("a--1", 5, 9), ('q"\\\u00e9', 1, 2)]
    D.write_keep_ranges(spark.createDataFrame([], "episode_key string, start_frame int, end_frame int"), path)
    assert D.read_keep_ranges(spark, path).count() == 0
    (tmp_path / "keep.json").write_text('{"a": [[1]]}')
    with pytest.raises(Exception, match="pairs of whole numbers"):
        D.read_keep_ranges(spark, path).collect()
