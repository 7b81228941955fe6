"""Changes of an episode dataset as numbered commits, so that two writers don't overwrite each other and a lost driver leaves no half change.

A writer stages frames and metadata lines in a folder of its own, then creates ``meta/log/<number>.json``, which only one writer can do: that is the commit. Publishing puts the staged files in place and writes the documents anew
from the parts of all commits; every step can be done again, and whoever comes next does it for a writer that was lost in between (``recover``). A writer whose number is taken stages again after the other one's episodes.

Metadata lines stay in ``meta/parts/<number>/`` and are put together into the layout's files, one row an episode, by one task that streams them; frames of former commits are not read. ``info.json`` names the commit that it shows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources import filesystem as fs

LINES = ("episodes", "episodes_stats", "expert_frame_index")
TRIES = 20
#: Tasks among which the folders of a dataset are dealt.
PARTS = 64


def open_store(path: str):
    from pyarrow import fs as store

    return store.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def names_in(store, folder: str) -> list[str]:
    """Names in a directory, sorted; empty if there is none."""
    from pyarrow import fs as arrow

    return sorted(f.base_name for f in store.get_file_info(arrow.FileSelector(folder, allow_not_found=True)))


def chunks_of(root: str) -> list[str]:
    """The names of a dataset's ``data/chunk-*`` folders: one for many episodes, so few."""
    store, folder = open_store(f"{root}/data")
    return [name for name in names_in(store, folder) if name.startswith("chunk-")]


def dealt(spark: SparkSession, chunks: list[str]) -> DataFrame:
    """chunk: the names dealt out to tasks. By an RDD and without a shuffle, so that Spark never takes rows that tasks make of them for as few as the names, and broadcasts them."""
    context = spark.sparkContext
    return spark.createDataFrame(context.parallelize([(c,) for c in chunks], max(1, min(len(chunks), max(PARTS, context.defaultParallelism)))), "chunk string")


def stream_lines(df: DataFrame, line: Column, order: Column, path: str, head: str = "", between: str = "\n", tail: str | None = None) -> None:
    """Lines in one file, in order, streamed by one task, perhaps with a head, a tail and another text between them. For tables of one row an episode or fewer."""
    last = between if tail is None else tail

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = open_store(path)
        store.create_dir(os.path.dirname(target), recursive=True)
        part, n = f"{target}.{uuid.uuid4().hex}.part", 0
        with store.open_output_stream(part) as out:
            out.write(head.encode())
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write((between if n else "").encode() + text.encode())
                    n += 1
            out.write(last.encode() if n or tail is not None else b"")
        store.move(part, target)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    lines = df.select(order.alias("_order"), line.alias("line")).repartition(1).sortWithinPartitions("_order")
    if not lines.select("line").mapInArrow(write, "n long").collect():  # one row; none where Spark knows that the table is empty and runs no task
        fs.write_text(df.sparkSession, path, head + (tail or ""))


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """line, episode_index of metadata files that exist."""
    found = [p for p in paths if fs.exists(spark, p)]
    rows = spark.read.text(found) if found else spark.createDataFrame([], "value string")
    return rows.where(F.trim("value") != "").select(F.col("value").alias("line"), F.get_json_object("value", "$.episode_index").cast("long").alias("episode_index"))


# ---- the log


def _name(version: int) -> str:
    return f"{version:08d}"


def _entry(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(fs.read_text(spark, f"{root}/meta/log/{_name(version)}.json"))


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last commit, 0 without any."""
    return max((int(n[:8]) for n in fs.children(spark, f"{root}/meta/log") if len(n) == 13 and n.endswith(".json")), default=0)


def head(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The last commit and what it says; 0 and None without any."""
    version = latest(spark, root)
    return version, _entry(spark, root, version) if version else None


def commit(spark: SparkSession, root: str, version: int, entry: dict, now: bool = True) -> bool:
    """Take a number and publish, or leave that to whoever comes next (``now`` false); False if another writer has it."""
    if not fs.put_if_absent(spark, f"{root}/meta/log/{_name(version)}.json", json.dumps({**entry, "version": version}, sort_keys=True)):
        return False
    if now:
        publish(spark, root)
    return True


def _by_chunks(spark: SparkSession, chunks: list[str], work: Callable[[str], int]) -> int:
    """Do something for each chunk's folder, by tasks; the sum of what it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(work(chunk) for batch in batches for chunk in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return dealt(spark, chunks).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] if chunks else 0


def _moved(store, source: str, target: str) -> int:
    """Rename over a file; 0 if the source, or the folder to move to, is gone, as another publisher was first."""
    try:
        store.move(source, target)
    except FileNotFoundError:
        return 0
    except OSError:  # what other stores say
        if store.get_file_info(source).is_file and store.get_file_info(target.rsplit("/", 1)[0]).type.name != "NotFound":
            raise
        return 0
    return 1


def _put_files(spark: SparkSession, staged: str, root: str, episodes: int, shrinks: bool) -> None:
    """Staged frames replace what stands in their place; then files of episodes that are no more go. Tasks rename, a chunk's files each.

    Files that go are first moved below the staged folder. Who finishes a commit takes that folder away, so a slower publisher of the same commit can't move files that a later commit put there.
    """

    def put(chunk: str) -> int:
        store, source = open_store(f"{staged}/data/{chunk}")
        target = open_store(f"{root}/data/{chunk}")[1]
        store.create_dir(target, recursive=True)
        stale = {f for f in names_in(store, target) if f.endswith(".crc")}
        n = 0
        for name in names_in(store, source):
            if name.endswith(".parquet") and not name.startswith("."):
                if f".{name}.crc" in stale:
                    store.delete_file(f"{target}/.{name}.crc")
                n += _moved(store, f"{source}/{name}", f"{target}/{name}")
        return n

    def drop(chunk: str) -> int:
        store, folder = open_store(f"{root}/data/{chunk}")
        gone = open_store(f"{staged}/gone")[1]
        try:
            store.create_dir(gone, recursive=False)
        except OSError:  # the staged folder is gone: another publisher finished this commit
            return 0
        return sum(_moved(store, f"{folder}/{name}", f"{gone}/{chunk}-{name}") for name in names_in(store, folder) if name.startswith("episode_") and int(name.split("_")[1].split(".")[0]) >= episodes)

    _by_chunks(spark, chunks_of(staged), put)
    if shrinks:
        _by_chunks(spark, chunks_of(root), drop)


def publish(spark: SparkSession, root: str) -> None:
    """Put every commit in place that isn't yet, and write the documents; again if another writer committed meanwhile."""
    while True:
        version, entry = head(spark, root)
        base = version
        while not _entry(spark, root, base)["base"]:
            base -= 1
        for v in range(base, version + 1):
            said = entry if v == version else _entry(spark, root, v)
            staged, part = f"{root}/{said['staged']}", f"{root}/meta/parts/{_name(v)}"
            if fs.exists(spark, staged):  # else all of it is in place
                _put_files(spark, staged, root, said["episodes"], said["shrinks"])
                if fs.exists(spark, f"{staged}/meta") and not fs.exists(spark, part):
                    fs.take_place(spark, f"{staged}/meta", part)
                fs.take_place(spark, staged, f"{staged}.old")
            for _ in range(TRIES):  # two that delete one folder at once may each leave what the other was at
                fs.remove(spark, f"{staged}.old")
                if not fs.exists(spark, f"{staged}.old"):
                    break
        for kind in LINES:
            rows = lines_of(spark, [f"{root}/meta/parts/{_name(v)}/{kind}.jsonl" for v in range(base, version + 1)])
            if entry["kinds"].get(kind):
                stream_lines(rows, F.col("line"), F.col("episode_index"), f"{root}/meta/{kind}.jsonl")
        fs.write_text(spark, f"{root}/meta/tasks.jsonl", "".join(json.dumps({"task_index": int(i), "task": name}) + "\n" for i, name in sorted(entry["tasks"].items(), key=lambda x: int(x[0]))))
        info = {"total_episodes": entry["episodes"], "total_frames": entry["frames"], "total_chunks": -(-entry["episodes"] // entry["chunks_size"]), "total_videos": 0, "commit": version}
        fs.write_text(spark, f"{root}/meta/info.json", json.dumps({**info, **{k: entry[k] for k in ("fps", "chunks_size", "features")}}, sort_keys=True, indent=1))
        if latest(spark, root) == version:
            return


def recover(spark: SparkSession, root: str) -> None:
    """Finish the change of a writer that was lost after its commit."""
    version = latest(spark, root)
    if version and (not fs.exists(spark, f"{root}/meta/info.json") or json.loads(fs.read_text(spark, f"{root}/meta/info.json")).get("commit") != version):
        publish(spark, root)


def parts(spark: SparkSession, root: str, kind: str) -> list[str]:
    """The files or folders of one kind that all commits since the last base wrote."""
    version, entry = head(spark, root)
    found = []
    while version:
        if fs.exists(spark, path := f"{root}/meta/parts/{_name(version)}/{kind}"):
            found.append(path)
        version = 0 if entry["base"] else version - 1
        entry = _entry(spark, root, version) if version else None
    return found[::-1]
