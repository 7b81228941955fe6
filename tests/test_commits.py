"""Changes of datasets: two writers at once, writers that are lost at any step, and what an append reads."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from framewright.operators import states
from framewright.sources import commits
from framewright.sources import datasets as D
from framewright.sources import episodes as E
from framewright.sources import filesystem as fs


def frames(spark, lengths, shift=0.0):
    rows = [(e, i, [float(e + i) + shift, shift], i % 3 == 0) for e, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, state array<double>, intervention boolean")


def whole(spark, root):
    """Everything a reader sees, and whether it fits together."""
    found = E.read_frames(spark, root).orderBy("index").collect()
    eps = E.read_episodes(spark, root).orderBy("episode_index").collect()
    info = E.read_info(spark, root).first()
    assert [r["index"] for r in found] == list(range(len(found))) and info.total_frames == len(found) and info.total_episodes == len(eps)
    assert [(r.episode_index, r.length) for r in eps] == [(e, sum(r.episode_index == e for r in found)) for e in range(len(eps))]
    stats = [json.loads(r.value)["episode_index"] for r in spark.read.text(f"{root}/meta/episodes_stats.jsonl").collect()]
    assert stats == list(range(len(eps))) and states.read_states(spark, commits.parts(spark, root, "states")).select("episode_index").distinct().count() == len(eps)
    assert [n for n in fs.children(spark, root) if n.startswith(".staged")] == []
    return [(r.episode_index, r.frame_index, tuple(r.state), r.task_index) for r in found]


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "set")
    D.append_episodes(frames(spark, [3, 2]), path, "fold", chunk_size=2)
    return path


def test_an_append_reads_no_old_frames(spark, root, tmp_path):
    before = whole(spark, root)
    old = next((tmp_path / "set/data").rglob("episode_000000.parquet"))
    content = old.read_bytes()
    (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    old.write_bytes(b"not read")
    D.append_episodes(frames(spark, [1, 4], 9.0), root, "pour", chunk_size=2)
    old.write_bytes(content)
    after = whole(spark, root)
    assert after[: len(before)] == before and [r[0] for r in after[len(before) :]] == [2, 3, 3, 3, 3] and {r[3] for r in after[len(before) :]} == {1}
    stats = {r.dim: r for r in D.dataset_statistics(spark, root).where("feature = 'state'").collect()}
    values = sorted(r[2][0] for r in after)
    assert stats[0].n == len(values) and stats[0]["mean"] == pytest.approx(sum(values) / len(values)) and (stats[0]["min"], stats[0]["max"], stats[0].error) == (values[0], values[-1], 0) and stats[0].q50 == values[(len(values) + 1) // 2 - 1]


def test_two_writers_at_once(spark, root):
    before, failed = whole(spark, root), []

    def work(name, shift):
        try:
            for _ in range(2):
                D.append_episodes(frames(spark, [2, 1], shift), root, name, chunk_size=2)
        except BaseException as reason:
            failed.append(reason)

    threads = [threading.Thread(target=work, args=a) for a in (("pour", 100.0), ("wipe", 200.0))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    after = whole(spark, root)
    assert after[: len(before)] == before and len(after) == len(before) + 12 and commits.latest(spark, root) == 5
    names = D.tasks_of(spark, root)
    assert all({100.0: "pour", 200.0: "wipe"}[r[2][1]] == names[r[3]] for r in after[len(before) :])


@pytest.mark.parametrize("step", ["put_if_absent", "take_place", "write_text", "stream_lines"])
@pytest.mark.parametrize("change", ["append", "remove"])
def test_a_writer_that_is_lost(spark, root, monkeypatch, step, change):
    """Stopped at any call of a step, with nothing cleaned up: what it left is the old dataset or, once somebody looks, the new one."""
    old = whole(spark, root)

    def run():
        if change == "append":
            D.append_episodes(frames(spark, [1, 2], 9.0), root, "pour", chunk_size=2)
        else:
            D.remove_episodes(spark, root, [0], chunk_size=2)

    where = commits if step == "stream_lines" else fs
    real, real_remove = getattr(where, step), fs.remove
    for n in range(20):
        calls = iter(range(100))

        def lost(*args, **more):
            if next(calls) == n:
                raise KeyboardInterrupt
            return real(*args, **more)

        version = commits.latest(spark, root)
        with monkeypatch.context() as m:
            m.setattr(where, step, lost)
            m.setattr(fs, "remove", lambda s, path: None if ".staged" in path else real_remove(s, path))
            try:
                run()
                stopped = False
            except KeyboardInterrupt:
                stopped = True
        taken = commits.latest(spark, root) > version
        commits.recover(spark, root)
        for name in fs.children(spark, root):
            if name.startswith(".staged"):
                fs.remove(spark, f"{root}/{name}")
        found = whole(spark, root)
        if taken:
            break
        assert stopped and found == old
    assert [r[0] for r in found] == ([*[0] * 3, 1, 1, 2, 3, 3] if change == "append" else [0, 0])


def test_a_dataset_of_another_tool_and_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "other")
    D.write_frames(frames(spark, [3, 2]).withColumn("task_index", F.lit(0).cast("long")), path, chunk_size=2)
    D.write_metadata(spark, path, {0: "fold"}, chunk_size=2)
    before = whole(spark, path)
    for name in ("log", "parts"):
        fs.remove(spark, f"{path}/meta/{name}")
    D.append_episodes(frames(spark, [1], 5.0), path, "pour", chunk_size=2)
    assert whole(spark, path)[: len(before)] == before and D.tasks_of(spark, path) == {0: "fold", 1: "pour"}
    D.write_metadata(spark, path, {0: "fold", 1: "pour"}, chunk_size=2)
    D.remove_episodes(spark, path, [1], chunk_size=2)
    left = whole(spark, path)
    assert [r[0] for r in left] == [0, 0, 0, 1] and left[-1][2][1] == 5.0
    D.remove_episodes(spark, path, [0, 1], chunk_size=2)
    assert commits.head(spark, path)[1]["episodes"] == 0 and fs.children(spark, f"{path}/data/chunk-000") == []
    D.append_episodes(frames(spark, [2], 7.0), path, "pour", chunk_size=2)
    assert [r[:2] for r in whole(spark, path)] == [(0, 0), (0, 1)]


def test_the_listing_outlives_cached_blocks(spark, tmp_path):
    listing = D.write_frames(frames(spark, [2, 1]).withColumn("task_index", F.lit(0)), str(tmp_path / "set"))
    spark.catalog.clearCache()
    assert sorted((r.episode_index, r.length) for r in listing.collect()) == [(0, 2), (1, 1)]


def test_lines_of_an_empty_table(spark, tmp_path):
    for i, empty in enumerate((spark.sql("SELECT 'x' AS line").where("1 = 0"), spark.range(3).select(F.lit("x").alias("line")).where(F.rand() > 2))):
        path = tmp_path / f"lines-{i}"
        commits.stream_lines(empty, F.col("line"), F.col("line"), str(path), head="[", between=",", tail="]")
        assert path.read_text() == "[]"
