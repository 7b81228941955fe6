"""A sink for metrics of a stream: every micro-batch once, steps that only rise, finite values.

A batch's lines are written first, then its number is taken by a small document that names them (``filesystem.put_if_absent``). Readers follow these documents, so a batch is there whole or not at all; a batch that is replayed
finds its number taken and changes nothing; what a lost driver left is never named.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources import filesystem as fs
from framewright.sources.commits import stream_lines


class MetricError(ValueError):
    """A batch that may not be logged."""


class MetricLog:
    """Lines of one JSON object: the step under ``step_name`` and each metric by its name, names in order."""

    def __init__(self, spark: SparkSession, root: str, step_name: str = "step"):
        self.spark, self.root, self.step_name = spark, root.rstrip("/"), step_name

    def _batches(self) -> list[int]:
        return sorted(int(n[:12]) for n in fs.children(self.spark, f"{self.root}/batches") if len(n) == 17 and n.endswith(".json"))

    def _said(self, batch: int) -> dict:
        return json.loads(fs.read_text(self.spark, f"{self.root}/batches/{batch:012d}.json"))

    def last_step(self) -> int | None:
        """The last step of all batches; batches without rows carry it on."""
        batches = self._batches()
        return self._said(batches[-1])["last_step"] if batches else None

    def write(self, df: DataFrame, batch: int) -> bool:
        """Log a batch of rows (step, metrics: map of name to number); False if it is there already. An error leaves the log as it was. For ``foreachBatch``."""
        batches = self._batches()
        if batch in batches:
            return False
        if batches and batch < batches[-1]:
            raise MetricError(f"batch {batch} after batch {batches[-1]}")
        rows = df.select(F.col("step").cast("long").alias("step"), F.col("metrics").cast("map<string,double>").alias("metrics"))
        values, names = F.map_values("metrics"), F.map_keys("metrics")
        bad_value = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        bad_name = F.exists(names, lambda n: (n == "") | (n == self.step_name))
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.count("step").alias("steps"), F.countDistinct("step").alias("distinct"), F.min("step").alias("first"), F.max("step").alias("last"), F.count(F.when(F.col("metrics").isNull() | bad_value, 1)).alias("values"), F.count(F.when(bad_name, 1)).alias("names")).first()
        before = self.last_step()
        if found.values or found["names"]:
            raise MetricError(f"{found['values']} rows with values that aren't finite, {found['names']} with names that are empty or taken")
        if found.n != found.steps or found.steps != found.distinct:
            raise MetricError("a step is null or occurs twice")
        if found.n and before is not None and found["first"] <= before:
            raise MetricError(f"step {found['first']} after step {before}")
        name = f"lines/{batch:012d}-{uuid.uuid4().hex}.jsonl"
        if found.n:
            pairs = F.array_sort(F.concat(F.transform(F.map_entries("metrics"), lambda e: F.struct(e["key"].alias("k"), e["value"].cast("string").alias("v"))), F.array(F.struct(F.lit(self.step_name).alias("k"), F.col("step").cast("string").alias("v")))))
            quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r'^\{"k":(.*)\}$', 1)
            line = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))
            stream_lines(rows, line, F.col("step"), f"{self.root}/{name}")
        said = {"lines": name if found.n else None, "rows": found.n, "last_step": found["last"] if found.n else before}
        return fs.put_if_absent(self.spark, f"{self.root}/batches/{batch:012d}.json", json.dumps(said, sort_keys=True))

    def read(self) -> DataFrame:
        """step, metrics of every logged row."""
        files = [f"{self.root}/{said['lines']}" for b in self._batches() if (said := self._said(b))["lines"]]
        lines = self.spark.read.text(files) if files else self.spark.createDataFrame([], "value string")
        every = F.from_json("value", "map<string,double>")
        return lines.select(F.get_json_object("value", f"$['{self.step_name}']").cast("long").alias("step"), F.map_filter(every, lambda k, _: k != self.step_name).alias("metrics"))
