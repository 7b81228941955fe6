"""Stored messages as a replayable source: files of rows under consecutive offsets, read as a table or as a rate-limited stream that restarts where it was.

``messages-<first offset>.parquet`` holds rows in the order of their offsets; the names and the last file's length say all there is. A stream's offset is the next message's number. How far a query came is read from its own
checkpoint's offset log, so a limited rate goes on after a restart and nothing is read twice or left out.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.pandas.types import from_arrow_schema

from framewright.operators.windows import dense_number
from framewright.sources.commits import open_store

ROWS_A_FILE, ROWS_A_TASK = 100_000, 50_000


def listing(path: str) -> list[tuple[int, int, str]]:
    """First offset, end and path of every file, in order."""
    from pyarrow import fs

    store, root = open_store(path)
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("messages-"))
    starts = [int(n[9:29]) for n in names]
    if not names:
        return []
    with store.open_input_file(f"{root}/{names[-1]}") as file:
        end = starts[-1] + pq.ParquetFile(file).metadata.num_rows
    return [(s, e, f"{path.rstrip('/')}/{n}") for s, e, n in zip(starts, [*starts[1:], end], names)]


def write_messages(df: DataFrame, path: str, order: str, rows_a_file: int = ROWS_A_FILE) -> int:
    """Store rows as messages after those that are there, in the order of a unique integer column; returns the next offset. A file is written by one task and moved into place; one writer at a time."""
    start = max((e for _, e, _ in listing(path)), default=0)
    rows = dense_number(df, order, "_n").withColumn("offset", F.col("_n") + start).withColumn("_file", F.floor(F.col("_n") / rows_a_file)).drop("_n")

    def write(table: pa.Table) -> pa.Table:
        part = table.drop_columns(["_file"]).sort_by("offset")
        store, target = open_store(f"{path.rstrip('/')}/messages-{part['offset'][0].as_py():020d}.parquet")
        store.create_dir(os.path.dirname(target), recursive=True)
        aside = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}.part"
        with store.open_output_stream(aside) as out:
            pq.write_table(part.select(["offset", *[c for c in part.column_names if c != "offset"]]), out, row_group_size=4096)
        store.move(aside, target)
        return pa.table({"end": pa.array([part["offset"][-1].as_py() + 1], pa.int64())})

    written = rows.groupBy("_file").applyInArrow(write, "end long").agg(F.max("end")).first()[0]
    return written or start


@dataclass
class Slice(InputPartition):
    """Messages of one file, by offset."""

    path: str
    first: int
    start: int
    end: int


def slices(path: str, start: int, end: int, most: int = ROWS_A_TASK) -> list[Slice]:
    return [Slice(p, first, at, min(at + most, stop, end)) for first, stop, p in listing(path) for at in range(max(first, start), min(stop, end), most)]


def read_slice(part: Slice) -> Iterator[pa.RecordBatch]:
    store, at = open_store(part.path)
    with store.open_input_file(at) as file:
        parquet = pq.ParquetFile(file)
        row = part.first
        for group in range(parquet.metadata.num_row_groups):
            n = parquet.metadata.row_group(group).num_rows
            lo, hi = max(part.start, row), min(part.end, row + n)
            if lo < hi:
                yield from parquet.read_row_group(group).slice(lo - row, hi - lo).to_batches()
            row += n


class StoredMessages(DataSource):
    """``spark.read`` or ``readStream`` ``.format("stored_messages")``; options: path, and for streams rate (messages a micro-batch at most) and checkpoint (the query's checkpointLocation; without it a restart needs an unlimited rate)."""

    @classmethod
    def name(cls) -> str:
        return "stored_messages"

    def schema(self):
        files = listing(self.options["path"])
        if not files:
            raise ValueError(f"no messages in {self.options['path']}")
        store, at = open_store(files[0][2])
        with store.open_input_file(at) as file:
            return from_arrow_schema(pq.ParquetFile(file).schema_arrow)

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Table(DataSourceReader):
    def __init__(self, options):
        self.path, self.start, self.end = options["path"], 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the offset choose files and rows."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("offset",):
                self.start = max(self.start, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("offset",):
                self.end = min(self.end, f.value)
            else:
                yield f

    def partitions(self):
        return slices(self.path, self.start, self.end)

    def read(self, partition):
        return read_slice(partition) if partition else iter(())  # None where no partition was planned


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.rate, self.checkpoint = options["path"], int(options.get("rate", 1 << 62)), options.get("checkpoint")
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def _planned(self) -> int:
        """Where the query's last planned batch ended, by its offset log."""
        from pyarrow import fs

        if not self.checkpoint:
            return 0
        store, root = open_store(f"{self.checkpoint.removeprefix('file://').rstrip('/')}/offsets")
        numbers = [int(f.base_name) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.isdigit()]
        if not numbers:
            return 0
        with store.open_input_stream(f"{root}/{max(numbers)}") as file:
            lines = file.read().decode().splitlines()
        return max((json.loads(x).get("offset", 0) for x in lines[2:] if x.startswith("{")), default=0)

    def latestOffset(self) -> dict:
        """At most ``rate`` messages after the last batch that was planned."""
        if self.at is None:
            self.at = self._planned()
        total = max((e for _, e, _ in listing(self.path)), default=0)
        return {"offset": max(self.at, min(total, self.at + self.rate))}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at or 0, end["offset"])
        return slices(self.path, start["offset"], end["offset"])

    def read(self, partition):
        return read_slice(partition)


def register(spark: SparkSession) -> None:
    """Make the format known; bounds of offsets reach it only if the session lets filters through."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredMessages)
