"""The versioned store: commits are atomic, conflicts are seen, keys stay unique, and what a killed writer leaves is never read."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from framewright.sources import filesystem as fs
from framewright.sources import versioned as V
from framewright.sources.label_store import LabelStore, checked_labels

TABLES = {"items": V.Table("id long, name string, n long", ("id",), (("name",),)), "notes": V.Table("id long, text string", ("id",))}


@pytest.fixture
def store(spark, tmp_path):
    return V.VersionedStore.create(spark, str(tmp_path / "store"), TABLES)


def items(spark, *rows):
    return spark.createDataFrame(rows, TABLES["items"].schema)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_snapshots_of_versions(spark, store):
    assert rows(store.snapshot("items")) == [] and store.latest() == 0
    assert store.append(items=items(spark, (1, "a", 1), (2, "b", 2))) == 1
    assert store.write(items=items(spark, (2, "c", 20), (3, "d", 3)).withColumn("_deleted", F.lit(False)), notes=spark.createDataFrame([(7, "hi")], TABLES["notes"].schema)) == 2
    assert store.write(items=items(spark, (1, None, None)).withColumn("_deleted", F.lit(True))) == 3
    assert rows(store.snapshot("items", 1)) == [(1, "a", 1), (2, "b", 2)]
    assert rows(store.snapshot("items", 2)) == [(1, "a", 1), (2, "c", 20), (3, "d", 3)]
    assert rows(store.snapshot("items")) == [(2, "c", 20), (3, "d", 3)] and rows(store.snapshot("notes")) == [(7, "hi")]
    again = V.VersionedStore(spark, store.root)
    assert rows(again.snapshot("items")) == rows(store.snapshot("items")) and again.tables == store.tables
    assert [(r.version, r.operation) for r in store.history().collect()] == [(0, "create"), (1, "append"), (2, "write"), (3, "write")]
    with pytest.raises(FileExistsError):
        V.VersionedStore.create(spark, store.root, TABLES)


def test_keys_and_unique_columns_are_held(spark, store):
    store.append(items=items(spark, (1, "a", 1), (4, None, 1), (5, None, 1)))  # nulls aren't compared
    for wrong in (items(spark, (1, "z", 1)), items(spark, (2, "b", 1), (2, "c", 1)), items(spark, (2, "a", 1)), items(spark, (2, "b", 1), (3, "b", 1)), items(spark, (None, "n", 1))):
        with pytest.raises(V.NotUnique):
            store.append(items=wrong)
    with pytest.raises(V.NotUnique):
        store.write(items=items(spark, (9, "a", 1)))
    store.write(items=items(spark, (1, "b", 1), (2, "a", 1)))  # a name may move on with its row
    assert store.latest() == 2 and rows(store.snapshot("items"))[:2] == [(1, "b", 1), (2, "a", 1)]
    assert len(fs.children(spark, f"{store.root}/data")) == 2  # refused rows are gone


def test_a_writer_that_read_an_old_version(spark, store):
    store.append(items=items(spark, (1, "a", 1), (2, "b", 1)))
    store.write(items=items(spark, (1, "a", 2)))
    with pytest.raises(V.Conflict):
        store.write(1, items=items(spark, (1, "a", 3)))
    assert store.write(1, items=items(spark, (2, "b", 3))) == 3
    assert rows(store.snapshot("items")) == [(1, "a", 2), (2, "b", 3)]


def test_between_staging_and_commit(spark, store, monkeypatch):
    """Another writer commits after the rows were checked: other keys go on after it, the same key is refused."""
    other = V.VersionedStore(spark, store.root)
    put, pending = V.VersionedStore._put, []

    def late(self, version, *rest, **more):
        if self is store and pending:
            other.append(items=pending.pop())
        return put(self, version, *rest, **more)

    monkeypatch.setattr(V.VersionedStore, "_put", late)
    pending.append(items(spark, (1, "a", 1)))
    assert store.append(items=items(spark, (2, "b", 2))) == 2
    pending.append(items(spark, (3, "c", 1)))
    with pytest.raises(V.NotUnique):
        store.append(items=items(spark, (3, "d", 2)))
    pending.append(items(spark, (4, "e", 1)))
    with pytest.raises(V.NotUnique):  # the same name under another key
        store.append(items=items(spark, (5, "e", 2)))
    pending.append(items(spark, (6, "f", 1)))
    with pytest.raises(V.Conflict):
        store.write(items=items(spark, (6, "g", 2)))
    pending.append(items(spark, (7, "h", 1)))
    seen = []

    def change(read):
        seen.append(read("items").count())
        return {"items": items(spark, (100, f"n{seen[-1]}", seen[-1]))}

    store.transact(change)
    assert seen == [5, 6] and (100, "n6", 6) in rows(store.snapshot("items"))  # made anew from what the other one wrote


@pytest.mark.parametrize("where", ["_check", "_put"])
def test_a_killed_append_leaves_the_old_version(spark, store, monkeypatch, where):
    store.append(items=items(spark, (1, "a", 1)))

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(V.VersionedStore, where, killed)
        m.setattr(fs, "remove", lambda *_: None)  # a lost driver cleans nothing up
        with pytest.raises(KeyboardInterrupt):
            store.append(items=items(spark, (2, "b", 2)))
    fresh = V.VersionedStore(spark, store.root)
    assert rows(fresh.snapshot("items")) == [(1, "a", 1)] and fresh.latest() == 1
    assert len(fs.children(spark, f"{store.root}/data")) == 2
    assert fresh.append(items=items(spark, (2, "b", 2))) == 2
    assert fresh.vacuum(grace=3600) == [] and len(fresh.vacuum(grace=-1)) == 1  # only the orphan
    assert rows(fresh.snapshot("items")) == [(1, "a", 1), (2, "b", 2)]


def test_two_writers_at_once(spark, store):
    """Threads append, change and count; no row is lost, none is there twice."""
    failed = []

    def work(number):
        mine = V.VersionedStore(spark, store.root)
        try:
            for i in range(3):
                mine.append(items=items(spark, (10 * number + i, f"{number}-{i}", i)))
                mine.transact(lambda read: {"notes": spark.createDataFrame([(0, str(int((read("notes").first() or (0, "0"))[1]) + 1))], TABLES["notes"].schema)})
        except BaseException as reason:
            failed.append(reason)

    threads = [threading.Thread(target=work, args=(n,)) for n in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert rows(store.snapshot("items")) == sorted((10 * n + i, f"{n}-{i}", i) for n in (1, 2) for i in range(3))
    assert rows(store.snapshot("notes")) == [(0, "6")] and store.latest() == 12


def test_only_one_of_many_gets_a_name(spark, tmp_path):
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append((fs.put_if_absent(spark, str(tmp_path / "one/x.json"), json.dumps(i)), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [i for won, i in got if won]
    assert json.loads(fs.read_text(spark, str(tmp_path / "one/x.json"))) == winner and fs.children(spark, str(tmp_path / "one")) == ["x.json"]


def test_compaction_and_vacuum(spark, store, monkeypatch):
    monkeypatch.setattr(V, "COMPACT_AFTER", 4)
    draw, plain = random.Random(2), {}
    for step in range(9):
        new = {draw.randrange(8): step for _ in range(3)}
        gone = {draw.randrange(8) for _ in range(2)} - set(new)
        plain = {k: v for k, v in {**plain, **new}.items() if k not in gone}
        change = [(k, f"k{k}", v, False) for k, v in new.items()] + [(k, None, None, True) for k in gone]
        store.write(items=spark.createDataFrame(change, TABLES["items"].schema + ", _deleted boolean"))
        assert rows(store.snapshot("items")) == sorted((k, f"k{k}", v) for k, v in plain.items())
    bases = [r.version for r in store.history().where("base").collect()]
    assert len(bases) > 2
    before = store.latest() - 1
    old = rows(store.snapshot("items", before))
    assert store.vacuum(before, grace=-1)
    fresh = V.VersionedStore(spark, store.root)
    assert rows(fresh.snapshot("items", before)) == old and rows(fresh.snapshot("items")) == rows(store.snapshot("items"))
    assert fresh.history().first().version == max(b for b in bases if b <= before)


def test_label_queue(spark, tmp_path):
    queue = LabelStore.create(spark, str(tmp_path / "labels"))
    one, two = queue.put_dataset("a", "/a", 30, 3, 30), queue.put_dataset("b", "/b", 30, 1, 5)
    assert (one, two) == (1, 2) and queue.put_dataset("a2", "/a", 30, 4, 40) == 1
    episodes = spark.createDataFrame([(0, 3), (1, 4), (5, 2)], "episode_index long, length long")
    queue.add_tasks(one, episodes, 5, 0.0)
    assert queue.add_tasks(one, episodes, 5, 1.0) is None  # they are there
    first = queue.claim([one], "x", 10.0)
    second = queue.claim([one], "y", 11.0)
    assert (first.task_id, second.task_id) == (1, 2) and first.locked_until == 310.0
    with pytest.raises(ValueError):
        queue.submit(1, "y", [0, 0, 2], 12.0)
    with pytest.raises(ValueError):
        queue.submit(1, "x", [2, 0, 0], 12.0)
    assert queue.submit(1, "x", [0, -1, 2], 12.0).status == "completed"
    assert queue.skip(2, "y", 13.0).status == "pending"
    assert queue.claim([one], "y", 14.0, exclude=2).task_id == 3
    assert queue.claim([one], "z", 15.0).task_id == 2 and queue.claim([one], "w", 16.0) is None and queue.claim([two], "w", 16.0) is None
    assert queue.heartbeat(3, "y", 100.0).locked_until == 400.0
    late = queue.claim([one], "w", 316.0)  # z's lease has ended, y's has not
    assert (late.task_id, late.locked_by) == (2, "w")
    assert queue.skip(2, "w", 317.0).status == "review"
    assert {r.status: r.n for r in queue.counts([one]).collect()} == {"pending": 0, "locked": 1, "completed": 1, "review": 1}
    log = queue.store.snapshot("events").orderBy("id").collect()
    assert [r.event_type for r in log] == ["claim", "claim", "submit", "skip", "claim", "claim", "heartbeat", "claim", "skip"]
    assert [(r.task_id, r.frame_states, r.done) for r in queue.store.snapshot("annotations").collect()] == [(1, [0, -1, 2], True)]
    assert queue.store.snapshot("datasets").count() == 2


def test_two_devices_never_get_one_task(spark, tmp_path):
    queue = LabelStore.create(spark, str(tmp_path / "labels"))
    queue.add_tasks(1, spark.range(6).select(F.col("id").alias("episode_index"), F.lit(2).alias("length")), 5, 0.0)
    got = []
    threads = [threading.Thread(target=lambda d=d: got.extend(LabelStore(V.VersionedStore(spark, queue.store.root)).claim([1], d, 1.0).task_id for _ in range(3))) for d in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4, 5, 6]


def test_labels_of_a_task():
    assert checked_labels([0, 1, 2], 3) == [0, 1, 2] and checked_labels([], 0) == []
    for wrong in ([0], [0, 2, 1], [0, 0, 3], [0, 0, True], [2, 2, 2]):
        with pytest.raises(ValueError):
            checked_labels(wrong, 3)
