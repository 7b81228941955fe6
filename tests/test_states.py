"""Mergeable states: merged is whole for every split, and quantiles are as near as they promise."""

import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.operators import states as S

SCHEMA = "episode_index long, frame_index long, state array<double>, gain double"
LEVELS = {"q00": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}


def merged(df, keys=("feature", "dim"), size=S.SIZE, fan=S.FAN):
    return S.with_statistics(S.merge_states(df, list(keys), size, fan), LEVELS).collect()


def held(row, values):
    """A state against the sorted values themselves."""
    n = len(values)
    assert row.n == n == sum(row.sizes) and row["min"] == values[0] and row["max"] == values[-1]
    assert row["mean"] == pytest.approx(statistics.fmean(values), abs=1e-9) and row["std"] == pytest.approx(statistics.pstdev(values), abs=1e-9)
    for name, level in LEVELS.items():
        rank = max(1, math.ceil(level * n))
        low, high = sum(x < row[name] for x in values) + 1, sum(x <= row[name] for x in values)
        assert low - row.error <= rank <= high + row.error, (name, rank, low, high, row.error)


def table(rng, draw):
    return [(e, i, [draw(), float(rng.randrange(4)), None], math.nan if rng.random() < 0.2 else draw()) for e in range(9) for i in range(rng.choice([1, 2, 40, 300]))]


@pytest.mark.parametrize("size, fan, part", [(16, 256, 65_536), (16, 3, 50), (1024, 4, 65_536), (1, 2, 100)])
def test_merged_is_whole_for_every_split(spark, monkeypatch, size, fan, part):
    monkeypatch.setattr(S, "PART", part)
    rng = random.Random(size + fan)
    rows = table(rng, lambda: rng.choice([rng.gauss(0, 1), rng.gauss(1e6, 1), 0.0, -1e12]))
    df = spark.createDataFrame(rows, SCHEMA)
    values = {("state", d): sorted(r[2][d] for r in rows) for d in (0, 1)} | {("gain", 0): sorted(r[3] for r in rows if not math.isnan(r[3]))}
    for parts in (1, 3):
        pieces = [S.partial_states(df.where(F.col("episode_index") % parts == p), size=size) for p in range(parts)]
        together = pieces[0]
        for piece in pieces[1:]:
            together = together.unionByName(piece)
        found = {(r.feature, r.dim): r for r in merged(together, size=size, fan=fan)}
        assert found.keys() == values.keys()
        for key, row in found.items():
            held(row, values[key]) if abs(values[key][0]) < 1e11 else _held_but_for_std(row, values[key])
            assert len(row.points) <= size and row.error <= len(values[key])
    episodes = {r.episode_index: r for r in merged(S.partial_states(df, ["state"], size), ("episode_index", "feature", "dim"), size, fan) if r.dim == 1}
    for e, row in episodes.items():
        held(row, sorted(r[2][1] for r in rows if r[0] == e))


def _held_but_for_std(row, values):
    """With a value of -1e12, sums of squares have no digits left for an absolute comparison."""
    assert row["std"] == pytest.approx(statistics.pstdev(values), rel=1e-9) and row["mean"] == pytest.approx(statistics.fmean(values), rel=1e-9)
    for name, level in LEVELS.items():
        rank = max(1, math.ceil(level * len(values)))
        assert sum(x < row[name] for x in values) + 1 - row.error <= rank <= sum(x <= row[name] for x in values) + row.error


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(-1e6, 1e6)), min_size=1, max_size=60), st.integers(1, 9))
def test_any_values(spark, drawn, size):
    count = {}
    rows = []
    for e, x in drawn:
        rows.append((e, count.setdefault(e, 0), x))
        count[e] += 1
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, x double")
    (row,) = merged(S.partial_states(df, size=size), size=size, fan=2)
    values = sorted(x for *_, x in rows)
    assert row.n == len(values) and row["mean"] == pytest.approx(statistics.fmean(values), abs=1e-6)
    for name, level in LEVELS.items():
        rank = max(1, math.ceil(level * len(values)))
        assert sum(x < row[name] for x in values) + 1 - row.error <= rank <= sum(x <= row[name] for x in values) + row.error


def test_small_states_are_exact_and_repeatable(spark):
    df = spark.createDataFrame([(e, i, float(i * 7 % 5)) for e in range(4) for i in range(20)], "episode_index long, frame_index long, x double")
    a, b = merged(S.partial_states(df)), merged(S.partial_states(df.repartition(3)), fan=2)
    assert a[0].error == 0 and a[0].points == sorted(float(i * 7 % 5) for _ in range(4) for i in range(20)) and a[0].points == b[0].points


def test_nothing_to_state(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merged(S.partial_states(none)) == []
    assert merged(S.partial_states(spark.createDataFrame([(0, 0, None, math.nan)], SCHEMA))) == []
