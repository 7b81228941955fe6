"""Queries of the library and their SQL, by the names of the survey's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, vectors: tuple[str, ...] = ()):
    """Register a query under its function's name, with the SQL that states the same.

    Columns named in ``vectors`` (arrays of one length) are reported one row an element, with its position ``pos``.
    """

    def add(fn: Query) -> Query:
        def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            rest = [c for c in df.columns if c not in vectors]
            return df.select(*rest, F.posexplode(F.arrays_zip(*vectors)).alias("pos", "_x")).select(*rest, F.col("pos").cast("long").alias("pos"), "_x.*")

        _QUERIES[fn.__name__] = elements if vectors else fn
        if sql and vectors:
            _SQL[fn.__name__] = f"SELECT * EXCLUDE ({', '.join(vectors)}), unnest(range(len({vectors[0]}))) AS pos, {', '.join(f'unnest({v}) AS {v}' for v in vectors)} FROM ({sql})"
        elif sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _load() -> None:
    from framewright.plans import queries_aggregate, queries_dataset, queries_filter, queries_quality, queries_records, queries_scalar, queries_sequence, queries_sessions, queries_storage, queries_store, queries_streams, queries_versioned  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
