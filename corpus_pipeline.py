"""A corpus pipeline of four stages: toxicity, language identification, near-duplicate removal, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of ``documents``; other columns are left out. Null and empty texts have no letter, so the second
stage takes them out; null ids and repeated rows go through, repeated rows up to the third stage, which keeps one of them. An empty table gives no bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import byte_cnn, near_dedup, packing, toxicity
from framewright.llm.common import DOCUMENT_COLUMNS, documents, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon calls toxic go."""
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, lexicon).select(*DOCUMENT_COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that read like none of the learned languages, go."""
    held_out = byte_cnn.fold_of("doc_id", 3) == 1
    network, least = byte_cnn.fit_known(docs.where(~held_out), docs.where(held_out))
    return byte_cnn.keep_identified(docs, network, least).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id."""
    return near_dedup.keep_first(docs.select(*DOCUMENT_COLUMNS))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins."""
    return packing.pack(materialize(packing.with_lengths(docs), "items"))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_known_languages), ("near_dedup", drop_near_duplicates), ("packing", pack_documents)]
ORACLE_SQL = None  # no stage can be stated in SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
