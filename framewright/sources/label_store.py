"""Labelling tasks on a versioned store: datasets, tasks, annotations and events change together, and two devices never hold one task."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from framewright.operators.sessions import LEASE_SECONDS, REVIEW_AFTER
from framewright.operators.store import claimable, status_counts
from framewright.operators.windows import dense_number
from framewright.sources.versioned import Table, VersionedStore

STATUSES = ["pending", "locked", "completed", "review"]
STATES = (-1, 0, 1, 2)
TABLES = {
    "datasets": Table("id long, name string, root_path string, fps double, total_episodes long, total_frames long", ("id",), (("root_path",),)),
    "tasks": Table("task_id long, dataset_id long, episode_index long, start_frame long, end_frame long, stride_source long, status string, locked_by string, locked_until double, skip_count long, updated_at double", ("task_id",), (("dataset_id", "episode_index", "start_frame", "end_frame"),)),
    "annotations": Table("task_id long, frame_states array<int>, done boolean, device_id string, created_at double", ("task_id",)),
    "events": Table("id long, task_id long, event_type string, device_id string, payload string, created_at double", ("id",)),
}


def checked_labels(labels: Sequence[int], length: int) -> list[int]:
    """A task's frame labels: one a frame, of STATES, and 2 at most once and last."""
    if len(labels) != length:
        raise ValueError(f"{len(labels)} labels for {length} frames")
    for i, label in enumerate(labels):
        if type(label) is not int or label not in STATES or (label == 2 and i != length - 1):
            raise ValueError(f"label {label!r} at frame {i}")
    return list(labels)


class LabelStore:
    """Times are seconds and are given by the caller."""

    def __init__(self, store: VersionedStore):
        self.store, self.spark = store, store.spark

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> LabelStore:
        return cls(VersionedStore.create(spark, root, TABLES))

    def put_dataset(self, name: str, root_path: str, fps: float, episodes: int, frames: int) -> int:
        """Insert a dataset, or bring the one with this root up to date; returns its id."""
        out = {}

        def change(read):
            known = read("datasets")
            old = known.where(F.col("root_path") == root_path).first()
            out["id"] = old.id if old else (known.agg(F.max("id")).first()[0] or 0) + 1
            return {"datasets": self.spark.createDataFrame([(out["id"], name, root_path, float(fps), episodes, frames)], TABLES["datasets"].schema)}

        self.store.transact(change)
        return out["id"]

    def add_tasks(self, dataset_id: int, episodes: DataFrame, stride: int, now: float) -> int | None:
        """A pending task for each episode (episode_index, length) that has none; ids go on from the largest one. Returns the version."""

        def change(read):
            known = read("tasks")
            new = episodes.select(F.lit(dataset_id).cast("long").alias("dataset_id"), F.col("episode_index").cast("long").alias("episode_index"), F.lit(0).cast("long").alias("start_frame"), F.col("length").cast("long").alias("end_frame"))
            new = new.join(known, ["dataset_id", "episode_index", "start_frame", "end_frame"], "left_anti")
            if new.isEmpty():
                return None
            start = (known.agg(F.max("task_id")).first()[0] or 0) + 1
            numbered = dense_number(new, "episode_index", "_n")
            none = F.lit(None)
            return {"tasks": numbered.select((F.col("_n") + start).alias("task_id"), "dataset_id", "episode_index", "start_frame", "end_frame", F.lit(stride).alias("stride_source"), F.lit("pending").alias("status"), none.alias("locked_by"), none.alias("locked_until"), F.lit(0).alias("skip_count"), F.lit(now).alias("updated_at"))}

        return self.store.transact(change)

    def claim(self, dataset_ids: list[int], device: str, now: float, exclude: int | None = None) -> Row | None:
        """Lock the first task that is pending or whose lease has ended, another one than ``exclude`` if there is one; None if there is none."""
        out: dict[str, Row | None] = {}

        def change(read):
            free = read("tasks").where(F.col("dataset_id").isin(dataset_ids))
            task = free.where(claimable(F.lit(now), exclude)).orderBy("task_id").first()
            if task is None and exclude is not None:
                task = free.where(claimable(F.lit(now))).orderBy("task_id").first()
            out["task"] = task
            return None if task is None else self._changed(read, out, {"status": "locked", "locked_by": device, "locked_until": now + LEASE_SECONDS}, "claim", device, now, {"locked_until": now + LEASE_SECONDS})

        self.store.transact(change)
        return out["task"]

    def heartbeat(self, task_id: int, device: str, now: float) -> Row:
        return self._own(task_id, device, lambda task: ({"locked_until": now + LEASE_SECONDS}, "heartbeat", {"locked_until": now + LEASE_SECONDS}, {}), now)

    def submit(self, task_id: int, device: str, labels: Sequence[int], now: float) -> Row:
        """Store a task's labels and complete it; labels of a task are stored once."""

        def step(task):
            states = checked_labels(labels, task.end_frame - task.start_frame)
            row = self.spark.createDataFrame([(task_id, states, 2 in states, device, now)], TABLES["annotations"].schema)
            return {"status": "completed", "locked_by": None, "locked_until": None}, "submit", {"done": 2 in states, "frame_count": len(states)}, {"annotations": row}

        return self._own(task_id, device, step, now)

    def skip(self, task_id: int, device: str, now: float) -> Row:
        """Free a task; one that was skipped so often goes to review."""

        def step(task):
            n = task.skip_count + 1
            status = "review" if n >= REVIEW_AFTER else "pending"
            return {"status": status, "locked_by": None, "locked_until": None, "skip_count": n}, "skip", {"skip_count": n, "status": status}, {}

        return self._own(task_id, device, step, now)

    def counts(self, dataset_ids: list[int]) -> DataFrame:
        return status_counts(self.store.snapshot("tasks").where(F.col("dataset_id").isin(dataset_ids)), STATUSES)

    def _own(self, task_id: int, device: str, step, now: float) -> Row:
        out: dict[str, Row | None] = {}

        def change(read):
            task = read("tasks").where(F.col("task_id") == task_id).first()
            if task is None or task.status != "locked" or task.locked_by != device:
                raise ValueError(f"task {task_id} isn't locked by {device}")
            fields, kind, payload, more = step(task)
            out["task"] = task
            return {**self._changed(read, out, fields, kind, device, now, payload), **more}

        self.store.transact(change)
        return out["task"]

    def _changed(self, read, out: dict, fields: dict, kind: str, device: str, now: float, payload: dict) -> dict[str, DataFrame]:
        """The task with new fields, and its event under the next id."""
        task = Row(**{**out["task"].asDict(), **fields, "updated_at": now})
        out["task"] = task
        number = (read("events").agg(F.max("id")).first()[0] or 0) + 1
        event = self.spark.createDataFrame([(number, task.task_id, kind, device, json.dumps(payload, sort_keys=True), now)], TABLES["events"].schema)
        return {"tasks": self.spark.createDataFrame([tuple(task)], TABLES["tasks"].schema), "events": event}
