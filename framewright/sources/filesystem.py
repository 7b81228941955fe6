"""Small documents and renames through Hadoop's file system API, so that any store Spark reads works. For metadata: nothing here moves rows."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _local(spark: SparkSession, path: str) -> str | None:
    """The path on this machine (or on a mount that all share), or None in any other store."""
    store, at = _at(spark, path)
    return at.toUri().getPath() if store.getUri().getScheme() == "file" else None


def _overwriting_rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename over a file: readers see the old one or the new one."""
    if (local := _local(spark, target)) is not None:
        folder, name = os.path.split(local)
        if os.path.exists(stale := f"{folder}/.{name}.crc"):
            os.remove(stale)  # of the former content
        os.replace(_local(spark, source), local)
        return
    java = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(java.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = java.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    to = java.org.apache.hadoop.fs.Path(target)
    java.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(java.org.apache.hadoop.fs.Path(source), to, overwrite)


def _write(spark: SparkSession, path: str, text: str) -> None:
    if (local := _local(spark, path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        return
    store, at = _at(spark, path)
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a document whole unless its name is taken; of several writers one gets True. On a local or mounted disk by a hard link, which never replaces; in any other store by its rename,
    which must not replace either (HDFS)."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    _write(spark, part, text)
    try:
        if (local := _local(spark, path)) is not None:
            os.link(_local(spark, part), local)
            return True
        store, at = _at(spark, part)
        _, to = _at(spark, path)
        return not store.exists(to) and bool(store.rename(at, to))
    except FileExistsError:
        return False
    finally:
        remove(spark, part)


def ages(spark: SparkSession, path: str) -> dict[str, float]:
    """Seconds since the last change of what is in a directory, by name."""
    store, at = _at(spark, path)
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    return {s.getPath().getName(): (now - s.getModificationTime()) / 1000 for s in store.listStatus(at)} if store.exists(at) else {}


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; an error if the target exists."""
    store, at = _at(spark, source)
    _, to = _at(spark, target)
    if store.exists(to):
        raise FileExistsError(target)
    store.mkdirs(to.getParent())
    if not store.rename(at, to):
        raise OSError(f"can't rename {source} to {target}")


def take_place(spark: SparkSession, source: str, target: str) -> None:
    """Rename to where nothing stands yet. Doing it again, or at the same time as another writer, changes nothing: there is one source, and who comes second finds it gone."""
    try:
        move(spark, source, target)
    except (OSError, Py4JJavaError):
        if exists(spark, source):
            raise


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory, sorted; empty if there is none, or none any more."""
    store, at = _at(spark, path)
    try:
        return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []
    except Py4JJavaError:
        if store.exists(at):
            raise
        return []


def walk(spark: SparkSession, path: str) -> list[str]:
    """Names of all files below a directory, relative to it, sorted."""
    store, at = _at(spark, path)
    found, top, files = [], store.makeQualified(at).toString().rstrip("/"), store.listFiles(at, True)
    while files.hasNext():
        found.append(files.next().getPath().toString()[len(top) + 1 :])
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Write a document beside its place and rename it over the old one, so that readers see the old one or the new one. Without ``replace`` a document that exists is an error."""
    if not replace:
        if not put_if_absent(spark, path, text):
            raise FileExistsError(path)
        return
    part = f"{path}.{uuid.uuid4().hex}.part"
    _write(spark, part, text)
    _overwriting_rename(spark, part, path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small document, whole."""
    if (local := _local(spark, path)) is not None:
        with open(local, encoding="utf-8") as file:
            return file.read()
    store, at = _at(spark, path)
    stream = store.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@contextmanager
def replaced(spark: SparkSession, *paths: str):
    """Keep copies of files or directories aside while they are rewritten: an error puts them back, success removes the copies."""
    aside = {p: f"{p}.{uuid.uuid4().hex}.old" for p in paths if exists(spark, p)}
    for path, old in aside.items():
        move(spark, path, old)
    try:
        yield
    except BaseException:
        for path in paths:
            remove(spark, path)
        for path, old in aside.items():
            move(spark, old, path)
        raise
    for old in aside.values():
        remove(spark, old)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the one that the cluster names in spark.checkpoint.dir; under /tmp only if that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or '/tmp/framewright-scratch').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to a scratch folder and read again: computed once for all that reads it, and still there when an executor is lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
