"""The training-data pipeline: documents in, sharded training rows out.

Each stage calls one operator of ``rankframe.llm``; its result is written as
Parquet and read back as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankframe.llm import decontaminate, mixing, sharding, simhash, toxicity
from rankframe.llm.common import shared_folder, table
from rankframe.llm.queries import toxic_training_rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learned from the labels, rejects go."""
    return toxicity.reject(docs, toxicity.learn(toxic_training_rows(spark, docs, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: 4-word shingles, at most
    4 differing bits."""
    return simhash.keep_first(docs, width=simhash.SHINGLE, radius=simhash.RADIUS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emit(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and slot."""
    return sharding.shard_rows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is a table in the
    shared folder, so a lost executor costs no finished stage."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SimHash (XXH64) and the learned lexicon can't be written in SQL.
ORACLE_SQL: str | None = None
