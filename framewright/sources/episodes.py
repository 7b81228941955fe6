"""Readers and writers of episode datasets: a directory with ``meta/`` (JSON, JSON lines) and ``data/chunk-*/episode_*.parquet``.

Frames are read by tasks through pyarrow's file systems, everything else through Spark's readers, so any Hadoop file system works.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.operators.windows import running_offset
from framewright.sources import commits

NAMES = {"observation.state": "state"}
NUMBER = re.compile(r"episode_(\d+)\.parquet")
#: What a reader gathers from small files before it hands rows to Spark.
BATCH_ROWS, BATCH_BYTES = 16_384, 1 << 24
EPISODES = "episode_index long, tasks array<string>, length long, num_frames long, episode_length long, dataset_from_index long, dataset_to_index long"


def plain(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores (``observation.state`` is ``state``), NaN in floats becomes null."""
    df = df.select(*[F.col(f"`{c}`").alias(NAMES.get(c, c.replace(".", "_"))) for c in df.columns])
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_frames(spark: SparkSession, root: str, after: int | None = None) -> DataFrame:
    """All frames, or those of episodes ``after`` one; ``plain``. Tasks list and read the files, a chunk's folder each, so the driver holds no file names; it reads one file's schema.

    Stores that pyarrow doesn't know are read by Spark, which lists all files in the driver.
    """
    try:
        chunks = commits.chunks_of(root)
        schema = file_schema(spark, root, chunks)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        chunks, schema = [], None
    if schema is None:  # no such store, or no file: an error
        return _later(plain(spark.read.parquet(f"{root}/data/chunk-*")), after)
    wanted = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        held, size, rows = [], 0, 0
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                store, folder = commits.open_store(f"{root}/data/{chunk}")
                for name in commits.names_in(store, folder):
                    if name.startswith((".", "_")) or (after is not None and (number := NUMBER.fullmatch(name)) and int(number[1]) <= after):
                        continue
                    with store.open_input_file(f"{folder}/{name}") as file:
                        parquet = pq.ParquetFile(file)
                        there = set(parquet.schema_arrow.names)
                        for part in parquet.iter_batches(8192, columns=[c for c in wanted.names if c in there], use_threads=False):
                            held.append(pa.Table.from_arrays([part[f.name].cast(f.type) if f.name in there else pa.nulls(part.num_rows, f.type) for f in wanted], schema=wanted))
                            size, rows = size + part.nbytes, rows + part.num_rows
                            if size > BATCH_BYTES or rows > BATCH_ROWS:
                                yield from pa.concat_tables(held).combine_chunks().to_batches()
                                held, size, rows = [], 0, 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return _later(plain(commits.dealt(spark, chunks).mapInArrow(read, schema)), after)


def _later(frames: DataFrame, after: int | None) -> DataFrame:
    return frames if after is None else frames.where(F.col("episode_index") > after)


def file_schema(spark: SparkSession, root: str, chunks: list[str] | None = None) -> T.StructType | None:
    """The schema that Spark reads from a dataset's first file, None if there is no file."""
    for chunk in commits.chunks_of(root) if chunks is None else chunks:
        store, folder = commits.open_store(f"{root}/data/{chunk}")
        for name in commits.names_in(store, folder):
            if not name.startswith((".", "_")):
                return spark.read.parquet(f"{root}/data/{chunk}/{name}").schema
    return None


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines give no row."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_info(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(f"{root}/meta/info.json")


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episode metadata with its length and the index of its first and past-the-last frame."""
    rows = with_length(read_json_lines(spark, f"{root}/meta/episodes.jsonl", EPISODES)).select("episode_index", "tasks", "length")
    return running_offset(rows, "episode_index", "length", "from_index").withColumn("to_index", F.col("from_index") + F.col("length"))


def with_length(df: DataFrame) -> DataFrame:
    """length, else num_frames, else episode_length, else the index range; an error if there is none."""
    spread = F.col("dataset_to_index") - F.col("dataset_from_index")
    found = F.coalesce("length", "num_frames", "episode_length", spread)
    return df.withColumn("length", F.when(F.assert_true(found.isNotNull(), "an episode without length").isNull(), found))


def read_tristate(spark: SparkSession, path: str, dataset: int = 0) -> DataFrame:
    """episode_index, frame_index, raw_state of a ready label document; partial documents and repeated episodes are errors."""
    schema = "ready boolean, datasets array<struct<dataset_id long, episodes array<struct<episode_index long, frame_states array<int>>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    ready = F.assert_true(F.col("ready") & (F.size("datasets") > dataset), "labels aren't ready, or no such dataset")
    episodes = doc.where(ready.isNull()).select(F.explode(F.col("datasets")[dataset]["episodes"]).alias("e")).select("e.*")
    grouped = episodes.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.first("frame_states").alias("s"))
    checked = grouped.where(F.assert_true(F.col("n") == 1, "an episode that is labelled twice").isNull())
    return checked.select("episode_index", F.posexplode("s").alias("frame_index", "raw_state"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress rows with defaults (dataset 0, valid); values that aren't finite become null, others must be in 0..1."""
    df = spark.read.parquet(path)
    for name, default in (("dataset_index", F.lit(0).cast("long")), ("valid_label", F.lit(True))):
        df = df.withColumn(name, F.coalesce(name, default) if name in df.columns else default)
    value = F.when(F.isnan("progress") | (F.abs("progress") == float("inf")), None).otherwise(F.col("progress"))
    inside = F.assert_true(value.isNull() | value.between(0, 1), "progress outside 0..1")
    return df.withColumn("progress", F.when(inside.isNull(), value))


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """episode, frame_index, qpos, action of HDF5 recordings, a file a task; needs h5py on the executors."""

    def run(frames):
        import io

        import h5py
        import pandas as pd

        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                with h5py.File(io.BytesIO(content)) as file:
                    qpos, action = file["/observations/qpos"][()], file["/action"][()]
                yield pd.DataFrame({"episode": name, "frame_index": range(len(qpos)), "qpos": list(qpos), "action": list(action)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "episode string, frame_index long, qpos array<double>, action array<double>")


def synthetic_frames(spark: SparkSession, episodes: int, length: int, width: int, seed: int) -> DataFrame:
    """Seeded random records."""
    rows = spark.range(episodes * length).select(F.floor(F.col("id") / length).alias("episode_index"), (F.col("id") % length).alias("frame_index"))
    return rows.withColumn("state", F.array(*[F.randn(seed + i).cast("float") for i in range(width)]))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_export(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with lists as JSON and booleans as true and false."""
    lists = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    flags = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    df.withColumns({**lists, **flags}).write.mode(mode).option("header", True).csv(path)
