"""Datasets of many episodes: files are written, renamed and read by tasks, and publishers that overtake each other lose nothing."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright.sources import commits
from framewright.sources import datasets as D
from framewright.sources import episodes as E
from framewright.sources import filesystem as fs


def frames(spark, lengths):
    rows = [(e, i, [float(100 * e + i)]) for e, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, state array<double>")


def seen(spark, root):
    return [(r.episode_index, r.frame_index, r["index"], r.state[0]) for r in E.read_frames(spark, root).orderBy("index").collect()]


def numbered(*kept):
    """What is seen of episodes of ``frames`` (number, length) in this order."""
    whole = [(e, i, float(100 * was + i)) for e, (was, n) in enumerate(kept) for i in range(n)]
    return [(e, i, at, x) for at, (e, i, x) in enumerate(whole)]


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "set")
    D.append_episodes(frames(spark, [3, 2, 4, 1]), path, "fold", chunk_size=2)
    return path


def test_the_driver_neither_lists_nor_renames_frames(spark, root, monkeypatch):
    """F1 to F5, F7: both grew with the number of episodes."""
    assert E.read_frames(spark, root).inputFiles() == []
    moved, real = [], fs.take_place
    monkeypatch.setattr(fs, "take_place", lambda s, source, target: (moved.append(source), real(s, source, target)))
    D.append_episodes(frames(spark, [1, 2, 1]), root, "fold")
    assert seen(spark, root) == numbered((0, 3), (1, 2), (2, 4), (3, 1), (0, 1), (1, 2), (2, 1)) and not [m for m in moved if m.endswith(".parquet")]


def test_frames_are_not_taken_for_few(spark, root):
    """a table made of a few folders' names was broadcast by its join with episodes."""
    plan = E.read_frames(spark, root)._jdf.queryExecution()
    assert int(str(plan.optimizedPlan().stats().sizeInBytes())) > 1 << 40 and "Exchange" not in plan.executedPlan().toString()


def test_episodes_that_go_may_be_a_table(spark, root):
    """they were a list in the driver."""
    D.remove_episodes(spark, root, E.read_episodes(spark, root).where("episode_index % 2 = 1"), chunk_size=2)
    assert seen(spark, root) == numbered((0, 3), (2, 4)) and commits.head(spark, root)[1]["episodes"] == 2
    D.remove_episodes(spark, root, E.read_episodes(spark, root).where("length > 9"), chunk_size=2)
    assert commits.latest(spark, root) == 2


def test_an_episode_is_streamed_in_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "ROWS_A_GROUP", 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        path = str(tmp_path / "set")
        listing = D.write_frames(frames(spark, [21, 1, 8]).orderBy(F.desc("frame_index")), path)
        assert sorted((r.episode_index, r.length) for r in listing.collect()) == [(0, 21), (1, 1), (2, 8)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    files = [pq.ParquetFile(f"{path}/data/chunk-000/episode_{e:06d}.parquet") for e in range(3)]
    assert [[f.metadata.row_group(g).num_rows for g in range(f.num_row_groups)] for f in files] == [[8, 8, 5], [1], [8]]
    assert seen(spark, path) == numbered((0, 21), (1, 1), (2, 8))


def test_files_of_another_tool(spark, root, tmp_path):
    table = pa.table({"frame_index": pa.array([0], pa.int32()), "episode_index": pa.array([4], pa.int64()), "index": pa.array([10], pa.int64()), "more": ["x"]})
    pq.write_table(table, tmp_path / "set/data/chunk-001/episode_000004.parquet")
    (tmp_path / "set/data/chunk-001/.episode_000009.parquet.part").write_bytes(b"")
    found = E.read_frames(spark, root).where("episode_index = 4").first()
    assert (found.frame_index, found["index"], found.state, found.task_index) == (0, 10, None, None)


def test_who_comes_second_takes_nothing_away(spark, tmp_path, monkeypatch):
    """another publisher renames between two steps of this one."""
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    fs.write_text(spark, source, "kept")
    real, real_move = fs.exists, fs.move

    def late(s, path):
        if path == source and real(s, source):
            real_move(s, source, target)
            return True
        return real(s, path)

    with monkeypatch.context() as m:
        m.setattr(fs, "exists", late)
        fs.take_place(spark, source, target)
    fs.take_place(spark, source, target)
    assert fs.read_text(spark, target) == "kept"


def test_a_slow_publisher_of_a_removal_takes_nothing_of_later_commits(spark, root):
    """a commit that shrinks the dataset is finished by another writer, who then appends; the slow one goes on with the former commit."""
    D.remove_episodes(spark, root, [1, 2, 3], chunk_size=2)
    staged = commits.head(spark, root)[1]["staged"]
    D.append_episodes(frames(spark, [2, 2]), root, "fold")
    commits._put_files(spark, f"{root}/{staged}", root, 1, True)
    assert seen(spark, root) == numbered((0, 3), (0, 2), (1, 2))
