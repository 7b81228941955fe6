"""Writing episode datasets on storage: append, delete, merge, metadata, label documents, statistics, shards and snapshots.

Frames are written, renamed and read by tasks, an episode a file; the driver only writes small documents. Tables of one row an episode (``meta/*.jsonl``) are written as one file by one task, which
streams them in order. A change is staged, committed under a number and published (``sources/commits.py``): two writers come one after the other, an error before the commit leaves no trace, and a change that was committed
is finished by whoever comes next. Appends read the new frames only.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.text import chunk_of
from framewright.operators import datasets, states
from framewright.operators.joins import range_join
from framewright.operators.statistics import QUANTILES, by_dimension
from framewright.operators.windows import renumber_episodes, runs
from framewright.sources import commits
from framewright.sources import episodes as E
from framewright.sources import filesystem as fs

CHUNK, FPS = 1000, 30.0
EPISODE_FILE = "episode_{:06d}.parquet"
#: What a random read takes at least.
ROWS_A_GROUP = 4096
PIECE = 1 << 22


def write_frames(df: DataFrame, root: str, chunk_size: int = CHUNK, fps: float = FPS, replace: bool = False) -> DataFrame:
    """Write frames as ``data/chunk-000/episode_000000.parquet``, with timestamp = frame_index / fps and, if df has none, a gap-free index. Returns episode_index, path, length.

    An episode is one group, bounded by its own length. A dataset that exists is an error unless ``replace``. A task that runs again writes the same file.
    """
    spark = df.sparkSession
    if fs.children(spark, f"{root}/data"):
        if not replace:
            raise FileExistsError(f"{root}/data")
        fs.remove(spark, f"{root}/data")
    return _written(df, root, chunk_size, fps)


def _written(df: DataFrame, root: str, chunk_size: int, fps: float) -> DataFrame:
    if "index" not in df.columns:
        counts = df.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
        df = renumber_episodes(df, counts).drop("new_episode")
    return _files(_timed(df, fps), root, chunk_size)


def _timed(df: DataFrame, fps: float) -> DataFrame:
    return df.withColumn("timestamp", (F.col("frame_index") / fps).cast("float"))


def _files(df: DataFrame, root: str, chunk_size: int) -> DataFrame:
    """An episode a file. A task streams its episodes, in order, a row group at a time."""
    rows = df.withColumn("_chunk", chunk_of("episode_index", chunk_size)).repartition("episode_index").sortWithinPartitions("episode_index", "frame_index")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of one episode, a row group at most."""
        for batch in batches:
            episodes = batch.column(batch.schema.get_field_index("episode_index")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(episodes[1:] != episodes[:-1]) + 1).tolist(), len(episodes)]
            table = pa.Table.from_batches([batch])
            for start, end in zip(cuts, cuts[1:]):
                for at in range(start, end, ROWS_A_GROUP):
                    yield table.slice(at, min(end - at, ROWS_A_GROUP))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        made, listed = set(), []
        open_episode, held, n, end = None, [], 0, None

        def flush(most: int) -> None:
            """Write full row groups; with 0 all that is held."""
            nonlocal held
            whole = pa.concat_tables(held)
            rows = whole.num_rows - (whole.num_rows % most if most else 0)
            if rows:
                end[0].write_table(whole.slice(0, rows).combine_chunks(), row_group_size=ROWS_A_GROUP)
            held = [whole.slice(rows)]

        def close() -> None:
            nonlocal held
            flush(0)
            writer, out, store, part, target, path = end
            writer.close()
            out.close()
            store.move(part, target)
            listed.append((open_episode, path, n))
            held = []

        def said() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"episode_index": pa.array([r[0] for r in listed], pa.int64()), "path": pa.array([r[1] for r in listed], pa.string()), "length": pa.array([r[2] for r in listed], pa.int64())})

        for piece in pieces(batches):
            episode = piece["episode_index"][0].as_py()
            if episode != open_episode or end is None:
                if end is not None:
                    close()
                    if len(listed) >= 4096:
                        yield said()
                        listed = []
                path = f"{root}/data/chunk-{piece['_chunk'][0].as_py():03d}/{EPISODE_FILE.format(episode)}"
                store, target = commits.open_store(path)
                folder = os.path.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}.part"
                out = store.open_output_stream(part)
                end = pq.ParquetWriter(out, piece.schema.remove(piece.schema.get_field_index("_chunk"))), out, store, part, target, path
                open_episode, n = episode, 0
            held.append(piece.drop_columns(["_chunk"]))
            n += piece.num_rows
            if sum(t.num_rows for t in held) >= ROWS_A_GROUP:
                flush(ROWS_A_GROUP)
        if end is not None:
            close()
        yield said()

    written = rows.mapInArrow(write, "episode_index long, path string, length long")
    # one row an episode; written once and kept, so that nothing of it is computed twice
    written.write.mode("overwrite").parquet(f"{root}/.written")
    return df.sparkSession.read.schema("episode_index long, path string, length long").parquet(f"{root}/.written")


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df in a few files, for the several passes that metadata takes over it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_lines(df: DataFrame, path: str, order: str) -> None:
    """One JSON object a line in one file, in order, streamed by one task. For tables of one row an episode or fewer."""
    commits.stream_lines(df, F.to_json(F.struct(*df.columns)), F.col(order), path)


def _stage_metadata(frames: DataFrame, folder: str, tasks: dict[int, str]) -> DataFrame:
    """Lines of some episodes and the states of their statistics; returns episode_index, task_index, length of each. frames: stored."""
    task = F.col("task_index") if "task_index" in frames.columns else F.lit(0)
    eps = frames.withColumn("_task", task.cast("long")).groupBy("episode_index").agg(F.min_by("_task", "frame_index").alias("task_index"), F.count(F.lit(1)).alias("length"))
    known = F.create_map(*[F.lit(x) for pair in (tasks or {0: ""}).items() for x in pair])
    write_lines(eps.select("episode_index", F.array(F.coalesce(known[F.col("task_index")], F.lit(""))).alias("tasks"), "length"), f"{folder}/episodes.jsonl", "episode_index")
    write_lines(episode_statistics(frames), f"{folder}/episodes_stats.jsonl", "episode_index")
    if "intervention" in frames.columns:
        found = runs(frames, F.col("intervention").cast("boolean")).groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct(F.col("start_frame").alias("start"), (F.col("end_frame") - 1).alias("end")))).alias("segments"))
        write_lines(eps.select("episode_index").join(found, "episode_index", "left").withColumn("segments", F.coalesce("segments", F.array())), f"{folder}/expert_frame_index.jsonl", "episode_index")
    states.write_states(frames, f"{folder}/states")
    return eps


def _entry_of(frames: DataFrame, staged: str, episodes: int, total: int, tasks: dict[int, str], fps: float, chunk_size: int, base: bool, shrinks: bool = False) -> dict:
    features = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    return {"base": base, "shrinks": shrinks, "staged": staged, "episodes": episodes, "frames": total, "tasks": tasks, "fps": fps, "chunks_size": chunk_size, "features": features, "kinds": {"episodes": True, "episodes_stats": True, "expert_frame_index": "intervention" in frames.columns}}


def write_metadata(spark: SparkSession, root: str, tasks: dict[int, str] | None = None, fps: float = FPS, chunk_size: int = CHUNK) -> None:
    """Rebuild ``meta/`` from the frames: info.json, tasks.jsonl, episodes.jsonl, episodes_stats.jsonl, expert_frame_index.jsonl (runs of ``intervention``) and the states of the statistics."""
    commits.recover(spark, root)
    for _ in range(commits.TRIES):
        version, staged = commits.latest(spark, root), f".staged-{uuid.uuid4().hex}"
        done = False
        try:
            frames = _kept(E.read_frames(spark, root), f"{root}/{staged}/rows")
            _stage_metadata(frames, f"{root}/{staged}/meta", tasks or {})
            eps = commits.lines_of(spark, [f"{root}/{staged}/meta/episodes.jsonl"])
            found = eps.agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("line", "$.length").cast("long")).alias("frames")).first()
            numbers = frames.select(F.col("task_index").cast("long")).distinct().toLocalIterator() if "task_index" in frames.columns else [(0,)]
            used = {i: (tasks or {}).get(i, "") for (i,) in numbers}  # tasks are few
            fs.remove(spark, f"{root}/{staged}/rows")
            done = commits.commit(spark, root, version + 1, _entry_of(frames, staged, found.n, found.frames or 0, used, fps, chunk_size, base=True))
        finally:
            if not done:
                fs.remove(spark, f"{root}/{staged}")
        if done:
            return
    raise RuntimeError(f"others committed in each of {commits.TRIES} tries")


def episode_statistics(frames: DataFrame) -> DataFrame:
    """episode_index, stats (by feature: min, max, mean, std and count of each dimension) of vector and number features."""
    vectors = [f.name for f in frames.schema.fields if isinstance(f.dataType, T.ArrayType)]
    numbers = [f.name for f in frames.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    wide = frames.select("episode_index", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in [*vectors, *numbers]]), F.array(*[F.col(v).cast("array<double>") for v in vectors], *[F.array(F.col(n).cast("double")) for n in numbers]))).alias("feature", "v"))
    of = by_dimension(wide, "v", ["episode_index", "feature"]).groupBy("episode_index", "feature", "dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))
    dims = of.groupBy("episode_index", "feature").agg(F.array_sort(F.collect_list(F.struct("dim", "min", "max", "mean", "std", "count"))).alias("d"))
    stats = F.struct(*[F.col(f"d.{s}").alias(s) for s in ("min", "max", "mean", "std", "count")])
    return dims.groupBy("episode_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", stats.alias("s"))))).alias("stats"))


def contract_differences(info: dict, df: DataFrame, fps: float = FPS) -> list[str]:
    """How frames to be appended differ from a dataset's contract (what info.json or a commit says): fps, column names or types. Empty if they may be appended."""
    declared = {n: t for n, t in info["features"].items() if n not in ("index", "timestamp", "episode_index")}
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in ("index", "timestamp", "episode_index")}
    wrong = [f"fps: {info['fps']} and {fps}"] if info["fps"] != fps else []
    return wrong + [f"{n}: {declared.get(n)} and {found.get(n)}" for n in sorted({*declared, *found}) if declared.get(n) != found.get(n)]


def tasks_of(spark: SparkSession, root: str) -> dict[int, str]:
    """Tasks are few; they are read to the driver."""
    return {r.task_index: r.task for r in E.read_json_lines(spark, f"{root}/meta/tasks.jsonl", "task_index long, task string").collect()}


def _adopt(spark: SparkSession, root: str) -> None:
    """A dataset that another tool wrote gets its first commit."""
    info = json.loads(fs.read_text(spark, f"{root}/meta/info.json"))
    write_metadata(spark, root, tasks_of(spark, root), info["fps"], info.get("chunks_size", CHUNK))


def append_episodes(df: DataFrame, root: str, task: str, fps: float = FPS, chunk_size: int = CHUNK, publish: bool = True) -> None:
    """Add the episodes of df (episode_index, frame_index, ...) with the next indices. Frames that are there are not read; if another writer commits first, the new ones are numbered and staged again after its episodes.

    Without ``publish`` the change is committed and put in place by the next writer or ``commits.recover``.
    """
    spark = df.sparkSession
    if not task.strip():
        raise ValueError("an empty task")
    commits.recover(spark, root)
    if not commits.latest(spark, root) and fs.exists(spark, f"{root}/meta/info.json"):
        _adopt(spark, root)
    mine = f"{root}/.staged-{uuid.uuid4().hex}"
    try:
        # numbered from 0 and kept, so that another try after another writer's commit only shifts numbers
        counts = df.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
        numbered = renumber_episodes(df, counts).withColumn("episode_index", F.col("new_episode")).drop("new_episode")
        for _ in range(commits.TRIES):
            if _try_append(spark, root, numbered, f"{mine}/rows", task, fps, chunk_size, publish):
                return
    finally:
        fs.remove(spark, mine)
    raise RuntimeError(f"others committed in each of {commits.TRIES} tries")


def _try_append(spark: SparkSession, root: str, numbered: DataFrame, path: str, task: str, fps: float, chunk_size: int, publish: bool) -> bool:
    """Stage episodes numbered from 0 behind the last commit's, and commit; False if another writer was first. path: where the rows are kept from the first try on."""
    version, former = commits.head(spark, root)
    tasks = {int(i): name for i, name in former["tasks"].items()} if former else {}
    number = next((i for i, name in tasks.items() if name == task), max(tasks, default=-1) + 1)
    if former and (wrong := contract_differences(former, numbered.withColumn("task_index", F.lit(number).cast("long")), fps)):
        raise ValueError(f"the frames don't fit the dataset: {wrong}")
    if not fs.exists(spark, f"{path}/_SUCCESS"):
        fs.remove(spark, path)
        _kept(numbered, path)
    episodes, total, chunks = (former["episodes"], former["frames"], former["chunks_size"]) if former else (0, 0, chunk_size)
    rows = spark.read.schema(numbered.schema).parquet(path).withColumn("task_index", F.lit(number).cast("long"))
    placed = _timed(rows.withColumns({"episode_index": F.col("episode_index") + episodes, "index": F.col("index") + total}), fps)
    staged, done = f".staged-{uuid.uuid4().hex}", False
    try:
        listing = _files(placed, f"{root}/{staged}", chunks).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("frames")).first()
        if not listing.n:
            fs.remove(spark, f"{root}/{staged}")
            return True
        frames = E.plain(placed)
        _stage_metadata(frames, f"{root}/{staged}/meta", {**tasks, number: task})
        done = commits.commit(spark, root, version + 1, _entry_of(frames, staged, episodes + listing.n, total + listing.frames, {**tasks, number: task}, fps, chunks, base=not former), publish)
    finally:
        if not done and commits.latest(spark, root) in (version, 0):
            fs.remove(spark, f"{root}/{staged}")
    if not done:
        fs.remove(spark, f"{root}/{staged}")
    return done


def remove_episodes(spark: SparkSession, root: str, gone: list[int] | DataFrame, chunk_size: int = CHUNK) -> None:
    """Delete episodes, a list or the ``episode_index`` of a table; later ones move up and indices have no gaps. Episodes before the first one that goes are neither read nor written."""
    gone = gone.select(F.col("episode_index").cast("long")) if isinstance(gone, DataFrame) else spark.createDataFrame([(g,) for g in sorted({*gone})], "episode_index long")
    commits.recover(spark, root)
    if not commits.latest(spark, root):
        _adopt(spark, root)
    for _ in range(commits.TRIES):
        version, former = commits.head(spark, root)
        wanted = gone.where((F.col("episode_index") >= 0) & (F.col("episode_index") < former["episodes"]))
        first, chunks = wanted.agg(F.min("episode_index")).first()[0], former["chunks_size"]
        if first is None:
            return
        tasks = {int(i): name for i, name in former["tasks"].items()}
        eps = E.read_episodes(spark, root).select("episode_index", "length", "from_index")
        start = eps.where(F.col("episode_index") == first).first().from_index
        later = E.read_frames(spark, root, after=first).drop("index")
        kept = datasets.delete_episodes(later, eps.where(F.col("episode_index") > first).select("episode_index", "length"), wanted)
        placed = kept.withColumn("episode_index", F.col("new_episode") + first).drop("new_episode").withColumn("index", F.col("index") + start)
        staged, done = f".staged-{uuid.uuid4().hex}", False
        folder = f"{root}/{staged}"
        try:
            rows = _kept(_timed(placed, former["fps"]), f"{folder}/rows")
            listing = _files(rows, folder, chunks).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("frames")).first()
            frames = E.plain(rows)
            _stage_metadata(frames, f"{folder}/new", tasks)
            for kind in commits.LINES:
                rows = commits.lines_of(spark, [f"{root}/meta/{kind}.jsonl"]).where(F.col("episode_index") < first).unionByName(commits.lines_of(spark, [f"{folder}/new/{kind}.jsonl"]))
                if former["kinds"][kind]:
                    commits.stream_lines(rows, F.col("line"), F.col("episode_index"), f"{folder}/meta/{kind}.jsonl")
            states.read_states(spark, commits.parts(spark, root, "states")).where(F.col("episode_index") < first).unionByName(states.read_states(spark, [f"{folder}/new/states"])).write.parquet(f"{folder}/meta/states")
            fs.remove(spark, f"{folder}/rows")
            entry = {**_entry_of(frames, staged, first + listing.n, start + (listing.frames or 0), tasks, former["fps"], chunks, base=True, shrinks=True), "features": former["features"], "kinds": former["kinds"]}
            done = commits.commit(spark, root, version + 1, entry)
        finally:
            if not done and commits.latest(spark, root) == version:
                fs.remove(spark, folder)
        if done:
            return
        fs.remove(spark, folder)
    raise RuntimeError(f"others committed in each of {commits.TRIES} tries")


def dataset_statistics(spark: SparkSession, root: str, keys: tuple[str, ...] = ("feature", "dim")) -> DataFrame:
    """keys, n, mean, std, min, max, q01, q10, q50, q90, q99 and error (the most ranks that a quantile may be off), from the states that commits stored; frames aren't read."""
    merged = states.merge_states(states.read_states(spark, commits.parts(spark, root, "states")), list(keys))
    return states.with_statistics(merged, {f"q{int(v * 100):02d}": v for v in QUANTILES}).drop("points", "sizes", "m2")


def merge_datasets(spark: SparkSession, roots: list[str], out: str, chunk_size: int = CHUNK) -> None:
    """One dataset of several, in the order given: episodes are renumbered, tasks encoded by first appearance, and all must have one contract."""
    info = json.loads(fs.read_text(spark, f"{roots[0]}/meta/info.json"))
    parts, tasks, offset = [], {}, 0
    for root in roots:
        frames = E.read_frames(spark, root)
        if wrong := contract_differences(info, frames, json.loads(fs.read_text(spark, f"{root}/meta/info.json"))["fps"]):
            raise ValueError(f"{root} doesn't fit: {wrong}")
        if "task_index" not in frames.columns:
            frames = frames.withColumn("task_index", F.lit(0).cast("long"))
        names = tasks_of(spark, root)
        for name in names.values():
            tasks.setdefault(name, len(tasks))
        known = F.create_map(*[F.lit(x) for i, name in names.items() for x in (i, tasks[name])])
        numbered = renumber_episodes(frames.drop("index"), E.read_episodes(spark, root))
        parts.append(numbered.withColumns({"episode_index": F.col("new_episode") + offset, "task_index": known[F.col("task_index")].cast("long")}).drop("new_episode", "index"))
        offset += E.read_episodes(spark, root).count()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    write_frames(whole, out, chunk_size, info["fps"])
    write_metadata(spark, out, {i: name for name, i in tasks.items()}, info["fps"], chunk_size)


# ---- documents beside a dataset ------------------------------------------------------------------------------------------------------


def write_label_document(df: DataFrame, path: str) -> str:
    """episode_index, frame_index, label as one document: ``labels.json`` if every frame has a label, else ``labels.partial.json``; the other one goes. Returns the kind.

    An episode is a row; one task streams them into the document, in order, so no row and no task holds all labels.
    """
    spark = df.sparkSession
    eps = df.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "label"))), lambda x: x["label"]).alias("frame_states"), F.count(F.when(F.col("label").isNull(), 1)).alias("open"))
    found = eps.agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("open")).first()
    ready = bool(found.n) and not found.open
    kind, other = ("labels.json", "labels.partial.json") if ready else ("labels.partial.json", "labels.json")
    episode = F.to_json(F.struct("episode_index", "frame_states"), {"ignoreNullFields": "false"})
    commits.stream_lines(eps, episode, F.col("episode_index"), f"{path}/{kind}", head=f'{{"ready":{json.dumps(ready)},"datasets":[{{"dataset_id":0,"episodes":[\n', between=",\n", tail="]}]}\n")
    fs.remove(spark, f"{path}/{other}")
    return kind


def write_progress(df: DataFrame, path: str, source: str, report: dict) -> None:
    """Progress rows as parquet and, beside them, where they come from: ``<path>.meta.json`` (Spark can't set a parquet file's own key-value metadata)."""
    df.write.mode("errorifexists").parquet(path)
    fs.write_text(df.sparkSession, f"{path}.meta.json", json.dumps({"progress_source": source, "progress_report": report}, sort_keys=True))


def write_norm_stats(df: DataFrame, path: str) -> None:
    """key, mean, std and perhaps q01, q99 (arrays) as ``norm_stats.json``: one row a feature, few."""
    names = [c for c in ("mean", "std", "q01", "q99") if c in df.columns]
    stats = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct(*names).alias("s")))))
    fs.write_text(df.sparkSession, f"{path}/norm_stats.json", df.agg(F.to_json(F.struct(stats.alias("norm_stats")))).first()[0])


def read_norm_stats(spark: SparkSession, path: str) -> DataFrame:
    """key, mean, std, q01, q99 of a document with or without the ``norm_stats`` level; ``observation.state`` is ``state``."""
    one = "map<string, struct<mean: array<double>, std: array<double>, q01: array<double>, q99: array<double>>>"
    text = spark.read.text(f"{path}/norm_stats.json", wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.norm_stats"), F.col("value"))
    rows = text.select(F.explode(F.from_json(inner, one)).alias("key", "s")).select(F.when(F.col("key") == "observation.state", "state").otherwise(F.col("key")).alias("key"), "s.*")
    return rows.where(F.assert_true(F.col("mean").isNotNull() & (F.size("mean") == F.size("std")), "statistics without mean and std of one width").isNull())


def publish_shard(df: DataFrame, path: str, contract: dict) -> dict:
    """Write rows once and for all with a manifest of their files (name, bytes, sha256), columns and rows. A shard that exists is never touched."""
    spark = df.sparkSession
    if fs.exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path}.{uuid.uuid4().hex}.part"
    df.write.parquet(staged)
    listed = hashed(spark, [f"{staged}/{name}" for name in fs.children(spark, staged) if name.endswith(".parquet")]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256").orderBy("name")
    manifest = {"contract": contract, "columns": dict(df.dtypes), "rows": spark.read.parquet(staged).count(), "files": [r.asDict() for r in listed.toLocalIterator()]}
    fs.write_text(spark, f"{staged}/manifest.json", json.dumps(manifest, sort_keys=True))
    fs.move(spark, staged, path)
    return manifest


def publish_snapshot(spark: SparkSession, catalog: str, shard: str, rows: int, contract: dict) -> list[dict]:
    """Append one shard's range to a catalog document. The contract must be the former one's; a shard is published once."""
    former = json.loads(fs.read_text(spark, catalog)) if fs.exists(spark, catalog) else {"contract": contract, "shards": []}
    if former["contract"] != contract or any(s["shard"] == shard for s in former["shards"]):
        raise ValueError("another contract, or the shard is in the catalog")
    start = former["shards"][-1]["end"] if former["shards"] else 0
    former["shards"].append({"shard": shard, "start": start, "end": start + rows})
    fs.write_text(spark, catalog, json.dumps(former, sort_keys=True))
    return former["shards"]


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as a JSON document."""
    fs.write_text(df.sparkSession, path, df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).first()[0])


# ---- random reads ---------------------------------------------------------------------------------------------------------------


def gather_stored(spark: SparkSession, root: str, requests: DataFrame, columns: list[str], step: int = 1) -> DataFrame:
    """place, episode_index, frame_index, columns, next_<column> (``step`` frames on; null past the episode's end), is_terminal and groups_read of each request (place, index: of all frames, gap-free).

    The catalogue of ranges says which file and which rows a request needs. Requests meet by file; a task opens it once and reads only the row groups and columns that are asked for. Other files are not opened. Requests
    outside the dataset give no row; repeated ones give one each.
    """
    info = json.loads(fs.read_text(spark, f"{root}/meta/info.json"))
    eps = E.read_episodes(spark, root).select("episode_index", "from_index", "to_index")
    width = max(1, -(-info["total_frames"] // max(1, info["total_episodes"])))
    placed = range_join(requests.select("place", "index"), eps, "index", "from_index", "to_index", [], width)
    placed = placed.select("place", "episode_index", (F.col("index") - F.col("from_index")).alias("frame_index"), (F.col("to_index") - F.col("from_index")).alias("length"), chunk_of("episode_index", info["chunks_size"]).alias("chunk"))
    kinds = {c: E.file_schema(spark, root)[c].dataType.simpleString() for c in columns}

    def read(asked: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        episode, length = asked["episode_index"][0].as_py(), asked["length"][0].as_py()
        now = asked["frame_index"].to_numpy()
        then = np.where(now + step < length, now + step, -1)
        store_, path = commits.open_store(f"{root}/data/chunk-{asked['chunk'][0].as_py():03d}/{EPISODE_FILE.format(episode)}")
        with store_.open_input_file(path) as file:
            parquet = pq.ParquetFile(file)
            ends = np.cumsum([parquet.metadata.row_group(g).num_rows for g in range(parquet.metadata.num_row_groups)])
            rows = np.unique(np.concatenate([now, then[then >= 0]]))
            groups = np.unique(np.searchsorted(ends, rows, side="right"))
            part = parquet.read_row_groups(groups.tolist(), columns=columns).combine_chunks()
        # where each wanted row stands among the groups that were read
        starts = np.concatenate([[0], ends[:-1]])
        sizes = (ends - starts)[groups]
        offset = starts[groups] - (np.cumsum(sizes) - sizes)

        def taken(at: np.ndarray) -> pa.Table:
            known = at >= 0
            group = np.searchsorted(groups, np.searchsorted(ends, np.where(known, at, 0), side="right"))
            return part.take(pa.array(np.where(known, at - offset[np.minimum(group, len(groups) - 1)], 0), pa.int64(), mask=~known))

        first, second = taken(now), taken(then)
        out = {"place": asked["place"], "episode_index": asked["episode_index"], "frame_index": asked["frame_index"]}
        out |= {c: first[c] for c in columns} | {f"next_{c}": second[c] for c in columns}
        return pa.table({**out, "is_terminal": pa.array(then < 0), "groups_read": pa.array(np.full(len(now), len(groups)))})

    schema = ", ".join(["place long, episode_index long, frame_index long", *[f"`{c}` {kinds[c]}" for c in columns], *[f"`next_{c}` {kinds[c]}" for c in columns], "is_terminal boolean, groups_read long"])
    return placed.groupBy("episode_index").applyInArrow(read, schema)


# ---- scans ---------------------------------------------------------------------------------------------------------------------------


def read_episode_files(spark: SparkSession, root: str) -> DataFrame:
    """Episode metadata in the parquet layout, ``meta/episodes/chunk-*/file-*.parquet``; episode_index and length must be there."""
    df = spark.read.option("mergeSchema", True).parquet(f"{root}/meta/episodes/chunk-*/file-*.parquet")
    if missing := {"episode_index", "length"} - set(df.columns):
        raise ValueError(f"episode metadata without {sorted(missing)}")
    return df.orderBy("episode_index")


def find_datasets(spark: SparkSession, root: str) -> list[str]:
    """The root itself if it is a dataset, else its children that are, in order."""
    if fs.exists(spark, f"{root}/meta/info.json"):
        return [root]
    return [f"{root}/{name}" for name in fs.children(spark, root) if fs.exists(spark, f"{root}/{name}/meta/info.json")]


def read_collection(spark: SparkSession, root: str) -> DataFrame:
    """Episode metadata of every dataset of a collection, with dataset_index and dataset."""
    parts = [E.read_episodes(spark, found).withColumns({"dataset_index": F.lit(i), "dataset": F.lit(found.rstrip("/").rsplit("/", 1)[-1])}) for i, found in enumerate(find_datasets(spark, root))]
    if not parts:
        raise ValueError(f"no dataset in {root}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_keep_ranges(ranges: DataFrame, path: str) -> None:
    """episode_key, start_frame, end_frame as a JSON object of lists of [start, end) pairs, a key a line, streamed in the order of keys by one task."""
    pair = F.struct(F.col("start_frame").cast("long").alias("a"), F.col("end_frame").cast("long").alias("z"))
    keys = ranges.where("episode_key IS NOT NULL").groupBy(F.col("episode_key").cast("string").alias("key")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.array(p["a"], p["z"]))).alias("pairs"))
    quoted = F.to_json(F.array("key"))
    commits.stream_lines(keys, F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(": "), "pairs"), F.col("key"), path, head="{\n", between=",\n", tail="\n}\n")


def json_members(pieces: Iterator[str]) -> Iterator[tuple[str, object]]:
    """Keys and values (objects, lists or strings) of one JSON object that comes in pieces; only one member at a time, and the piece it lies in, are held."""
    decoder, held, at, ended, wanted = json.JSONDecoder(), "", 0, False, 1

    def more() -> bool:
        nonlocal held, at, ended, wanted
        held, at = held[at:], 0
        new: list[str] = []
        while not ended and sum(map(len, new)) < wanted:
            piece = next(pieces, None)
            ended = piece is None
            new.append(piece or "")
        held += "".join(new)
        return any(new)

    def token() -> str:
        nonlocal at
        while True:
            while at < len(held) and held[at] in " \t\r\n":
                at += 1
            if at < len(held):
                return held[at]
            if not more():
                return ""

    def value():
        nonlocal at, wanted
        token()
        while True:
            try:
                found, at = decoder.raw_decode(held, at)
                wanted = 1
                return found
            except json.JSONDecodeError:
                wanted = max(1, len(held) - at)  # as much again, so that a long value is tried a few times only
                if not more():
                    raise

    def take(sign: str) -> None:
        nonlocal at
        if token() not in sign or not token():
            raise ValueError(f"{token()!r} in the document in place of one of {sign}")
        at += 1

    take("{")
    if token() == "}":
        at += 1
    else:
        while True:
            if token() != '"':
                raise ValueError("a member without a name")
            key = value()
            take(":")
            if token() not in ("[", "{", '"'):
                raise ValueError(f"{key}: neither a list nor an object")
            yield key, value()
            end = token()
            take(",}")
            if end == "}":
                break
    if token():
        raise ValueError("text behind the document")


def read_keep_ranges(spark: SparkSession, path: str) -> DataFrame:
    """episode_key, start_frame, end_frame of a JSON object of lists of [start, end) pairs, however laid out. One task streams the document; it holds one key's pairs at a time. Other documents are an error."""
    shape = "episode_key string, start_frame long, end_frame long"

    def pieces(file) -> Iterator[str]:
        decode = codecs.getincrementaldecoder("utf-8")()
        while piece := file.read(PIECE):
            yield decode.decode(piece)
        yield decode.decode(b"", True)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store_, at = commits.open_store(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
                with store_.open_input_stream(at) as file:
                    rows: list[tuple[str, int, int]] = []
                    for key, ranges in json_members(pieces(file)):
                        if not isinstance(ranges, list) or any(not isinstance(r, list) or len(r) != 2 or type(r[0]) is not int or type(r[1]) is not int for r in ranges):
                            raise ValueError(f"{key}: not a list of pairs of whole numbers")
                        rows += [(key, a, z) for a, z in ranges]
                        if len(rows) >= 65_536:
                            yield _keep_batch(rows)
                            rows = []
                    yield _keep_batch(rows)

    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(run, shape)


def _keep_batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"episode_key": pa.array([r[0] for r in rows], pa.string()), "start_frame": pa.array([r[1] for r in rows], pa.int64()), "end_frame": pa.array([r[2] for r in rows], pa.int64())})


def hashed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes, sha256 of files, read in pieces by tasks, so a file may be of any size."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store_, at = commits.open_store(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
                digest, size = hashlib.sha256(), 0
                with store_.open_input_stream(at) as file:
                    while piece := file.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1024)))
    return rows.mapInArrow(run, "path string, bytes long, sha256 string")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), state (bytes and sha256 of the content) of every file, for two scans to be compared; transaction folders (``.staged-``, ``.part``) are left out. Names pass through the driver, contents don't."""
    left_out = re.compile(r"(^|/)\.(staged|written)|\.part(/|$)|\.old(/|$)|\.crc$")
    names = [n for n in fs.walk(spark, root) if not left_out.search(n)]
    found = hashed(spark, [f"{root.rstrip('/')}/{n}" for n in names])
    return found.select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30).alias("path"), F.concat_ws(":", F.col("bytes").cast("string"), "sha256").alias("state"))
