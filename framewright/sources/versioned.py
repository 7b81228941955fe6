"""A store of keyed tables with atomic commits: a numbered log of small documents beside immutable parquet files.

``log/<number>.json`` names the folders that a commit added, one for each table it changed. A commit is the creation of the next number, which only one writer can do (``filesystem.put_if_absent``), so several tables change together
or not at all. Whatever fails before that leaves folders that no entry names: readers never see them and ``vacuum`` deletes them; there is nothing else to recover after a lost driver.

A commit's rows replace rows of the same key, or delete them. A snapshot of a version is the last row of each key among the commits up to it, one aggregation by key. Every ``COMPACT_AFTER`` commits the snapshot is
written as a base from which later ones start, so the log that a reader looks at stays short; the folders' names tell the version of a row, so all commits are read in one scan.

Keys and unique columns are held at commit: new rows are checked against the snapshot that they were made from, and, if others have committed since, against what those changed. The log's entries are small and pass through the
driver; rows don't.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.sources import filesystem as fs

COMPACT_AFTER = 32
TRIES = 20
DELETED = "_deleted"


class Conflict(RuntimeError):
    """Another writer changed the same keys, or took the version."""


class NotUnique(ValueError):
    """A key or unique columns would occur twice."""


@dataclass(frozen=True)
class Table:
    """A table's columns (DDL), its key and further column lists that are unique. Null keys are refused; unique columns with a null are not compared, as in SQL."""

    schema: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = field(default=())


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._entries: dict[int, dict] = {}
        self.tables = {name: Table(t["schema"], tuple(t["key"]), tuple(map(tuple, t["unique"]))) for name, t in self._entry(self._base(self.latest()))["tables"].items()}

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: dict[str, Table]) -> VersionedStore:
        """A new store of empty tables, version 0; an error if there is one."""
        said = {name: {"schema": t.schema, "key": t.key, "unique": t.unique} for name, t in tables.items()}
        if not fs.put_if_absent(spark, f"{root.rstrip('/')}/log/{0:020d}.json", json.dumps({"version": 0, "operation": "create", "base": True, "writes": {}, "tables": said})):
            raise FileExistsError(root)
        return cls(spark, root)

    # ---- the log

    def _entry(self, version: int) -> dict:
        if version not in self._entries:  # entries never change
            self._entries[version] = json.loads(fs.read_text(self.spark, f"{self.root}/log/{version:020d}.json"))
        return self._entries[version]

    def latest(self) -> int:
        numbers = [int(name[:20]) for name in fs.children(self.spark, f"{self.root}/log") if len(name) == 25 and name.endswith(".json")]
        if not numbers:
            raise FileNotFoundError(f"no store at {self.root}")
        return max(numbers)

    def _base(self, version: int) -> int:
        while not self._entry(version)["base"]:
            version -= 1
        return version

    def history(self) -> DataFrame:
        """version, operation and rows by table of every commit in the log."""
        return self.spark.read.schema("version long, operation string, base boolean, rows map<string, long>").json(f"{self.root}/log/*.json").orderBy("version")

    # ---- reading

    def _rows(self, table: str, versions: range) -> DataFrame | None:
        """What commits wrote, with the version of each row; None if they wrote nothing."""
        folders = {path.split("/")[1]: v for v in versions if (path := self._entry(v)["writes"].get(table))}
        if not folders:
            return None
        paths = [f"{self.root}/data/{name}/{table}" for name in folders]
        version_of = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
        rows = self.spark.read.schema(f"{self.tables[table].schema}, {DELETED} boolean").parquet(*paths)
        return rows.withColumn("_version", version_of[F.regexp_extract("_metadata.file_path", f"/data/([0-9a-f]{{32}})/{table}/", 1)])

    def snapshot(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows at a version, the latest one if none is given."""
        version = self.latest() if version is None else version
        spec, base = self.tables[table], self._base(version)
        rows = self._rows(table, range(base, version + 1))
        if rows is None:
            return self.spark.createDataFrame([], spec.schema)
        rest = [c for c in rows.columns if c not in (*spec.key, "_version")]
        if sum(table in self._entry(v)["writes"] for v in range(base, version + 1)) > 1:  # else its keys are unique as they are
            rows = rows.groupBy(*spec.key).agg(F.max_by(F.struct(*rest), "_version").alias("_last")).select(*spec.key, "_last.*")
        return rows.where(~F.col(DELETED)).select(*T._parse_datatype_string(spec.schema).names)

    def changes(self, table: str, after: int, until: int | None = None) -> DataFrame | None:
        """What commits after one version up to another wrote, deletions marked; compactions change nothing."""
        until = self.latest() if until is None else until
        found = self._rows(table, [v for v in range(after + 1, until + 1) if not self._entry(v)["base"]])
        return found.drop("_version") if found is not None else None

    # ---- writing

    def _stage(self, folder: str, changes: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
        """Write rows beside the store; returns the rows as written and how many there are."""
        staged, counts = {}, {}
        for table, df in changes.items():
            fields = T._parse_datatype_string(self.tables[table].schema).fields
            deleted = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in df.columns else F.lit(False)
            path = f"{self.root}/data/{folder}/{table}"
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], deleted.alias(DELETED)).write.parquet(path)
            staged[table] = self.spark.read.schema(f"{self.tables[table].schema}, {DELETED} boolean").parquet(path)
            key = self.tables[table].key
            found = staged[table].agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in key]) != "0" * len(key), 1)).alias("nulls")).first()
            if found.nulls:
                raise NotUnique(f"{table}: a key is null")
            counts[table] = found.n
            for columns in (key, *self.tables[table].unique):
                self._refuse(table, columns, (staged[table] if columns == key else self._live(staged[table], columns)).groupBy(*columns).count().where("count > 1"))
        return staged, counts

    @staticmethod
    def _live(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return df.where(~F.col(DELETED)).dropna(subset=list(columns))

    def _refuse(self, table: str, columns: tuple[str, ...], found: DataFrame) -> None:
        if (row := found.select(*columns).first()) is not None:
            raise NotUnique(f"{table}: {row.asDict()}")

    def _check(self, staged: dict[str, DataFrame], against: Callable[[str], DataFrame | None], insert: bool) -> None:
        """New rows against others: inserts may not share a key, and no row may share unique columns with a row of another key."""
        for table, rows in staged.items():
            others, spec = against(table), self.tables[table]
            if others is None:
                continue
            if insert:
                self._refuse(table, spec.key, rows.where(~F.col(DELETED)).join(others.select(*spec.key), list(spec.key), "left_semi"))
            for columns in spec.unique:
                # rows whose key is written anew are judged by what is written
                kept = others.join(rows.select(*spec.key), list(spec.key), "left_anti").dropna(subset=list(columns))
                self._refuse(table, columns, self._live(rows, columns).join(kept.select(*columns), list(columns), "left_semi"))

    def _put(self, version: int, operation: str, folder: str, counts: dict[str, int], base: bool = False) -> bool:
        entry = {"version": version, "operation": operation, "base": base, "rows": counts, "writes": {t: f"data/{folder}/{t}" for t in counts}}
        if base:
            entry["tables"] = {name: {"schema": t.schema, "key": t.key, "unique": t.unique} for name, t in self.tables.items()}
        return fs.put_if_absent(self.spark, f"{self.root}/log/{version:020d}.json", json.dumps(entry))

    def _commit(self, read: int, changes: dict[str, DataFrame], operation: str, insert: bool, again: bool) -> int:
        """Stage, check and put. If others committed in between: with ``again`` the rows are held against what those wrote and put after them, else a Conflict."""
        folder, done = uuid.uuid4().hex, False
        try:
            staged, counts = self._stage(folder, changes)
            self._check(staged, lambda table: self.snapshot(table, read), insert)
            seen = read
            for _ in range(TRIES):
                if self._put(seen + 1, operation, folder, counts):
                    done = True
                    return seen + 1
                if not again:
                    raise Conflict(f"version {read + 1} is taken")
                latest = self.latest()
                for table, rows in staged.items():
                    if (others := self.changes(table, seen, latest)) is not None:
                        key = list(self.tables[table].key)
                        if not insert and (row := rows.join(others.select(*key), key, "left_semi").first()) is not None:
                            raise Conflict(f"{table}: {row.asDict()}")
                self._check(staged, lambda table, seen=seen, latest=latest: None if (others := self.changes(table, seen, latest)) is None else others.where(~F.col(DELETED)), insert)
                seen = latest
            raise Conflict(f"no version was free in {TRIES} tries")
        finally:
            if not done:
                fs.remove(self.spark, f"{self.root}/data/{folder}")
            elif seen + 1 - self._base(seen + 1) >= COMPACT_AFTER:
                self.compact()

    def append(self, **rows: DataFrame) -> int:
        """Insert rows into tables; NotUnique if a key is there. Other writers' inserts of other keys in between don't matter. Returns the version."""
        return self._commit(self.latest(), rows, "append", insert=True, again=True)

    def write(self, read: int | None = None, **rows: DataFrame) -> int:
        """Replace rows by key (and delete those with a true ``_deleted``); Conflict if one of the keys changed after version ``read``."""
        latest = self.latest()
        read = latest if read is None else read
        for table, df in rows.items():
            key = list(self.tables[table].key)
            others = self.changes(table, read, latest)
            if others is not None and (row := df.join(others.select(*key), key, "left_semi").first()) is not None:
                raise Conflict(f"{table}: {row.asDict()}")
        return self._commit(latest, rows, "write", insert=False, again=True)

    def transact(self, change: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame] | None]) -> int | None:
        """Write what ``change`` makes of a snapshot (a function from a table's name to its rows). If any other commit comes in between, it is made anew from the new snapshot. None if it wants no change."""
        for attempt in range(TRIES):
            read = self.latest()
            changes = change(lambda table, read=read: self.snapshot(table, read))
            if not changes:
                return None
            try:
                return self._commit(read, changes, "transact", insert=False, again=False)
            except Conflict:
                time.sleep(0.01 * attempt)
        raise Conflict(f"others committed in each of {TRIES} tries")

    # ---- upkeep

    def compact(self) -> int | None:
        """Write the snapshot as a new base. None if another commit came first; the next one will do it."""
        read, folder = self.latest(), uuid.uuid4().hex
        _, counts = self._stage(folder, {t: self.snapshot(t, read) for t in self.tables})
        if self._put(read + 1, "compact", folder, counts, base=True):
            return read + 1
        fs.remove(self.spark, f"{self.root}/data/{folder}")
        return None

    def vacuum(self, keep_from: int | None = None, grace: float = 3600.0) -> list[str]:
        """Delete what versions from ``keep_from`` on (the latest one if none is given) don't need: entries before their base, folders that only those name, and folders and parts of failed writers older than ``grace`` seconds. Returns the folders' names."""
        latest = self.latest()
        base = self._base(latest if keep_from is None else keep_from)
        log = fs.ages(self.spark, f"{self.root}/log")
        old = sorted(int(n[:20]) for n in log if len(n) == 25 and int(n[:20]) < base)
        of = lambda versions: {path.split("/")[1] for v in versions for path in self._entry(v)["writes"].values()}
        kept, gone = of(range(base, latest + 1)), of(old)
        gone |= {n for n, age in fs.ages(self.spark, f"{self.root}/data").items() if age > grace and n not in kept}
        for version in old:
            fs.remove(self.spark, f"{self.root}/log/{version:020d}.json")
        for name in gone - kept:
            fs.remove(self.spark, f"{self.root}/data/{name}")
        for name, age in log.items():
            if name.endswith(".part") and age > grace:
                fs.remove(self.spark, f"{self.root}/log/{name}")
        return sorted(gone - kept)
