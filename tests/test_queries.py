"""Every query with SQL against DuckDB on the smallest tables."""

import math

import pytest

from framewright.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int) and abs(v) > 999_999_999:
        return v  # nine digits would hide a difference
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows_as_sql(name, spark, duck):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    cursor = duck.execute(registry.oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in order]) for r in cursor.fetchall())
