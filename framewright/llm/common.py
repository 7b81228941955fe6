"""What the operators share: shared storage, Arrow batches, words and the document table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Used only where the session names no shared folder and runs on one machine, as in local tests.
LOCAL_SCRATCH = "/tmp/framewright-scratch"
#: So many keys (8 bytes each) are sent to every task at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_MULTIPLY, _FINISH = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only if that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors. ``discard`` deletes the table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def matched(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df joined with ``keys``, one row a key: sent to all tasks if they are few by count, else by a shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("merge"), column)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(column, folds: int):
    """crc32 of the id as text, modulo the number of folds; a null id is in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def slices(batch: pa.RecordBatch, column: int, rows: int = 4000, size: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has more than ``rows`` rows or, but for a single row, ``size`` bytes in the column. What Arrow holds for parts that are done goes back to the system."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        most = (ends[start - 1] if start else 0) + size
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, most, side="right"))))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FINISH
    return x ^ (x >> np.uint64(32))


def chain(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of sequences that are one longer."""
    return mix(hashes * _MULTIPLY + more)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words between white space, and where each text's begin and the last one's end; null texts have none."""
    # trimmed, because the split leaves a single last blank in the last word
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    if not len(coded):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    table = np.array([xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    found = table[coded.indices.to_numpy()]
    words = found != 0
    return found[words], np.concatenate([[0], np.cumsum(words)])[offsets]


def map_text(df: DataFrame, fn: Callable[[list, list], dict], schema: str, id_column: str = "doc_id", text_column: str = "text", setup: Callable[[], object] | None = None, rows: int = 2000) -> DataFrame:
    """Run ``fn(ids, texts)`` over Arrow batches of whole texts; null texts arrive as None.

    ``fn`` returns a dict of column name to list or Arrow array, in the order of ``schema``. Batches are cut to
    ``rows`` rows, which bounds what one call holds. ``setup`` runs once in each task and its result is passed as a third argument.
    """
    names = [part.strip().split(" ")[0] for part in _top_level(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                out = fn(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *state)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], _ARROW.get(kind)) for n, kind in zip(names, _kinds(schema))], names=names)

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _top_level(schema: str) -> list[str]:
    parts, depth, last = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(last)
            last = ""
        else:
            last += ch
    return [*parts, last]


def _kinds(schema: str) -> list[str]:
    return [part.strip().split(" ", 1)[1] for part in _top_level(schema)]
