"""Random reads, draws and quantiles that stay exact and even whatever the values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import sampling, statistics
from framewright.sources import datasets as D


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = [(e, i, [float(100 * e + i)], f"{e}-{i}") for e, n in enumerate((40, 3, 25)) for i in range(n)]
    D.append_episodes(spark.createDataFrame(rows, "episode_index long, frame_index long, state array<double>, name string").repartition(2), path, "fold", chunk_size=2)
    return path


def test_only_what_is_asked_for_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "ROWS_A_GROUP", 8)
    path = str(tmp_path / "set")
    rows = [(e, i, [float(100 * e + i)], f"{e}-{i}") for e, n in enumerate((40, 3, 25)) for i in range(n)]
    D.append_episodes(spark.createDataFrame(rows, "episode_index long, frame_index long, state array<double>, name string"), path, "fold", chunk_size=2)
    other = next((tmp_path / "set/data").rglob("episode_000001.parquet"))
    requests = [(0, 5), (1, 39), (2, 7), (3, 5), (4, 43 + 24), (5, 43), (6, 999), (7, -1)]
    # the schema is read from any file, so the middle one may be broken only after that; nothing else touches it
    frame = D.gather_stored(spark, path, spark.createDataFrame(requests, "place long, index long"), ["state", "name"])
    (other.parent / f".{other.name}.crc").unlink(missing_ok=True)
    other.write_bytes(b"not read")
    found = {r.place: r for r in frame.collect()}
    assert {p: (r.name, r.next_name, r.is_terminal) for p, r in found.items()} == {0: ("0-5", "0-6", False), 1: ("0-39", None, True), 2: ("0-7", "0-8", False), 3: ("0-5", "0-6", False), 4: ("2-24", None, True), 5: ("2-0", "2-1", False)}
    assert found[0].state == [5.0] and found[2].next_state == [8.0] and found[1].next_state is None
    assert {found[p].groups_read for p in (0, 1, 2, 3)} == {3} and {found[p].groups_read for p in (4, 5)} == {2}  # of five and four


def test_stored_batches_equal_a_plain_look_up(spark, root):
    draw = random.Random(4)
    requests = [(p, draw.randrange(68)) for p in range(200)]
    found = {r.place: r for r in D.gather_stored(spark, root, spark.createDataFrame(requests, "place long, index long"), ["name"], step=3).collect()}
    names = [f"{e}-{i}" for e, n in enumerate((40, 3, 25)) for i in range(n)]
    for place, index in requests:
        later = names[index + 3] if index + 3 < 68 and names[index + 3].split("-")[0] == names[index].split("-")[0] else None
        assert (found[place].name, found[place].next_name, found[place].is_terminal) == (names[index], later, later is None)


def test_draws_are_wide(spark):
    values = [r[0] for r in spark.range(4000).select(sampling.draw(1, "id")).collect()]
    assert max(values) > 1 << 59 and all(0 <= v < 1 << 60 for v in values) and len({v % 4_294_967_296 for v in values}) == 4000
    assert abs(sum(v < 1 << 59 for v in values) - 2000) < 160


@pytest.mark.parametrize("n", [0, 1, 7, 500, 999, 1000, 5000])
def test_a_subset_is_the_smallest_hashes(spark, n):
    df = spark.range(1000).withColumn("_x", F.lit(1))
    found = sorted(r.id for r in sampling.shuffled_subset(df, n, "id", 5).collect())
    every = sorted((r.d, r.id) for r in df.select("id", sampling.draw(5, "id").alias("d")).collect())
    assert found == sorted(i for _, i in every[:n])


@pytest.mark.parametrize("most", [10, 100, 1_000_000])
@pytest.mark.parametrize("kind", ["heavy", "ties", "infinite", "even", "one", "two"])
def test_quantiles_are_exact_and_no_task_sorts_many(spark, kind, most):
    rng = random.Random(kind)
    values = {"heavy": [rng.random() for _ in range(3000)] + [1e12], "ties": [float(rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(3000)] + [rng.random() for _ in range(50)], "infinite": [math.inf] * 40 + [-math.inf] * 3 + [rng.gauss(0, 1) for _ in range(900)], "even": [float(i) for i in range(5000)], "one": [3.5], "two": [1.0, math.inf]}[kind]
    levels = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    rows = spark.createDataFrame([(d, x) for d in (0, 3) for x in values] + [(0, None)], "dim int, x double")
    found = {r.dim: r for r in statistics.exact_quantiles(rows, levels, [f"q{i}" for i in range(7)], most).collect()}
    ordered = np.sort(values)
    for i, level in enumerate(levels):
        at = (len(values) - 1) * level
        lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
        assert found[0][f"q{i}"] == found[3][f"q{i}"] == want or (math.isnan(want) and math.isnan(found[0][f"q{i}"])), (level, want)


def test_quantiles_of_nothing(spark):
    assert statistics.exact_quantiles(spark.createDataFrame([(0, None)], "dim int, x double"), [0.5], ["q50"]).collect() == []
