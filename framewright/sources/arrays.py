"""Shards of arrays: ``shard-<first index>/<column>.npy`` with a manifest of sizes and digests, written by tasks and read by ranges of the index.

A file is the plain array format: a header that names type, order and shape, then the values; row i of a shard stands at a known byte, so a range of rows is one read. A manifest says what each file must be; a header or size
that differs is refused when a range is planned or read, and with ``verify`` (the default) so is a digest that differs, for which each task reads its shard's files once in pieces.
"""

from __future__ import annotations

import ast
import hashlib
import json
import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from framewright.sources.commits import open_store

ROWS_A_SHARD, ROWS_A_BATCH, PIECE = 65_536, 8192, 1 << 22
MAGIC = b"\x93NUMPY"
TYPES = {"<f4": "float", "<f8": "double", "<i4": "int", "<i8": "long", "|u1": "short", "|b1": "boolean"}


class BrokenShard(ValueError):
    """A file that isn't what its manifest says."""


def header(descr: str, shape: tuple[int, ...]) -> bytes:
    """Version 1.0 of the format, padded so that the values begin at a multiple of 64 bytes."""
    text = repr({"descr": descr, "fortran_order": False, "shape": shape}).encode()
    padding = -(len(MAGIC) + 4 + len(text) + 1) % 64
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(text) + padding + 1) + text + b" " * padding + b"\n"


def parse_header(data: bytes) -> tuple[str, tuple[int, ...], int]:
    """Type, shape and where the values begin. data: the file's first 64 KB or all of it."""
    if data[:6] != MAGIC or len(data) < 10:
        raise BrokenShard("not an array file")
    if data[6] == 1:
        size, start = struct.unpack_from("<H", data, 8)[0], 10
    elif data[6] in (2, 3) and len(data) >= 12:
        size, start = struct.unpack_from("<I", data, 8)[0], 12
    else:
        raise BrokenShard(f"version {data[6]} of the format")
    if len(data) < start + size:
        raise BrokenShard("a header that is cut off")
    try:
        said = ast.literal_eval(data[start : start + size].decode("latin1").strip())
        descr, order, shape = said["descr"], said["fortran_order"], said["shape"]
    except (ValueError, SyntaxError, KeyError, TypeError) as reason:
        raise BrokenShard("a header that can't be read") from reason
    if descr not in TYPES or order or not isinstance(shape, tuple) or not shape or any(type(n) is not int or n < 0 for n in shape):
        raise BrokenShard(f"an array of {descr!r}, {shape!r}, in column order {order!r}")
    return descr, shape, start + size


# ---- writing


def write_arrays(df: DataFrame, root: str, index: str, columns: list[str], rows_a_shard: int = ROWS_A_SHARD) -> int:
    """Write columns (numbers, or arrays of one length without nulls) by a gap-free index 0..n-1; returns the number of rows. A shard is one group of ``rows_a_shard`` rows; its folder is moved into place whole."""

    def write(table: pa.Table) -> pa.Table:
        part = table.sort_by("_at")
        at = part["_at"].to_numpy()
        if len(np.unique(at)) != len(at) or at[-1] - at[0] + 1 != len(at) or at[0] % rows_a_shard:
            raise ValueError(f"the index has gaps or repeats after {at[0]}")
        store, target = open_store(f"{root.rstrip('/')}/shard-{at[0]:020d}")
        aside, files = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}.part", {}
        store.create_dir(aside, recursive=True)
        for name in columns:
            column = part[name].combine_chunks()
            if column.null_count:
                raise ValueError(f"{name}: a null")
            shape: tuple[int, ...] = (len(column),)
            if pa.types.is_list(column.type):
                lengths = np.unique(np.asarray(column.value_lengths()))
                if len(lengths) != 1 or column.flatten().null_count:
                    raise ValueError(f"{name}: arrays of several lengths, or nulls in them")
                shape, column = (len(column), int(lengths[0])), column.flatten()
            values = column.to_numpy(zero_copy_only=False)
            descr = values.dtype.str
            if descr not in TYPES:
                raise ValueError(f"{name}: {column.type}")
            content = header(descr, shape) + np.ascontiguousarray(values).tobytes()
            with store.open_output_stream(f"{aside}/{name}.npy") as out:
                out.write(content)
            files[name] = {"descr": descr, "shape": shape, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
        with store.open_output_stream(f"{aside}/manifest.json") as out:
            out.write(json.dumps({"start": int(at[0]), "rows": len(at), "files": files}, sort_keys=True).encode())
        from pyarrow import fs

        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.delete_dir(target)  # of an attempt of the same task
        store.move(aside, target)
        return pa.table({"rows": pa.array([len(at)], pa.int64())})

    rows = df.select(F.col(index).cast("long").alias("_at"), *columns).withColumn("_shard", F.floor(F.col("_at") / rows_a_shard))
    return rows.groupBy("_shard").applyInArrow(write, "rows long").agg(F.sum("rows")).first()[0] or 0


# ---- reading


def manifests(root: str) -> list[tuple[str, dict]]:
    """Folders and what their manifests say, in order; an error if a shard is missing between others."""
    from pyarrow import fs

    store, at = open_store(root)
    found, end = [], 0
    for info in sorted(store.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda f: f.path):
        if info.base_name.startswith("shard-"):
            with store.open_input_stream(f"{info.path}/manifest.json") as file:
                said = json.loads(file.read())
            if said["start"] != end or int(info.base_name[6:]) != end:
                raise BrokenShard(f"{info.base_name} after row {end}")
            end += said["rows"]
            found.append((f"{root.rstrip('/')}/{info.base_name}", said))
    return found


@dataclass
class Rows(InputPartition):
    """Rows of one shard, by their place in it."""

    folder: str
    said: dict
    start: int
    end: int


def read_rows(part: Rows, columns: list[str], verify: bool) -> Iterator[pa.RecordBatch]:
    store, folder = open_store(part.folder)
    places = {}
    for name in columns:
        said, path = part.said["files"][name], f"{folder}/{name}.npy"
        with store.open_input_file(path) as file:
            descr, shape, begin = parse_header(file.read(min(file.size(), 1 << 16)))
            row = np.dtype(descr).itemsize * math.prod(shape[1:])
            if descr != said["descr"] or list(shape) != list(said["shape"]) or shape[0] != part.said["rows"] or file.size() != said["bytes"] or begin + row * shape[0] != said["bytes"]:
                raise BrokenShard(f"{path}: {descr} {shape}, {file.size()} bytes")
            if verify:
                digest = hashlib.sha256()
                file.seek(0)
                while piece := file.read(PIECE):
                    digest.update(piece)
                if digest.hexdigest() != said["sha256"]:
                    raise BrokenShard(f"{path}: another digest")
        places[name] = descr, shape, begin, row, path
    for start in range(part.start, part.end, ROWS_A_BATCH):
        n = min(ROWS_A_BATCH, part.end - start)
        out = [pa.array(np.arange(part.said["start"] + start, part.said["start"] + start + n))]
        for descr, shape, begin, row, path in places.values():
            with store.open_input_file(path) as file:
                file.seek(begin + start * row)
                values = np.frombuffer(file.read(n * row), descr)
            values = values.astype(np.int16) if descr == "|u1" else values
            width = math.prod(shape[1:])
            flat = pa.array(values)
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat) if len(shape) > 1 else flat)
        yield pa.RecordBatch.from_arrays(out, names=["index", *columns])


class ArrayShards(DataSource):
    """``spark.read.format("array_shards")``; options: path, columns (comma-joined, all if left out), verify (true). Bounds of ``index`` choose shards and rows."""

    @classmethod
    def name(cls) -> str:
        return "array_shards"

    def _columns(self) -> list[str]:
        found = manifests(self.options["path"])
        if not found:
            raise BrokenShard(f"no shards in {self.options['path']}")
        return self.options["columns"].split(",") if self.options.get("columns") else sorted(found[0][1]["files"])

    def schema(self) -> str:
        files = manifests(self.options["path"])[0][1]["files"] if self._columns() else {}
        kinds = {c: TYPES[files[c]["descr"]] for c in self._columns()}
        return ", ".join(["index long", *[f"`{c}` {f'array<{k}>' if len(files[c]['shape']) > 1 else k}" for c, k in kinds.items()]])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._columns(), str(self.options.get("verify", "true")).lower() == "true")


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], verify: bool):
        self.path, self.columns, self.verify, self.start, self.end = path, columns, verify, 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            bounds = {GreaterThanOrEqual: (0, None), GreaterThan: (1, None), LessThan: (None, 0), LessThanOrEqual: (None, 1), EqualTo: (0, 1)}.get(type(f))
            if bounds is None or f.attribute != ("index",) or type(f.value) is not int:
                yield f
                continue
            low, high = bounds
            self.start = self.start if low is None else max(self.start, f.value + low)
            self.end = self.end if high is None else min(self.end, f.value + high)

    def partitions(self):
        found = []
        for folder, said in manifests(self.path):
            lo, hi = max(0, self.start - said["start"]), min(said["rows"], self.end - said["start"])
            if lo < hi:
                found.append(Rows(folder, said, lo, hi))
        return found

    def read(self, partition):
        return read_rows(partition, self.columns, self.verify) if partition else iter(())  # None where no partition was planned


def register(spark: SparkSession) -> None:
    """Make the format known; bounds of the index reach it only if the session lets filters through."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayShards)
