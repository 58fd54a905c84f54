"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# --- fixed values ---------------------------------------------------------------
#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# --- end of fixed values ----------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """doc_id and the whole text (null: empty) of every document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def id_remainder(doc_id, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
                   .cast("binary")) % m


def py_remainder(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def word_count(text) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, seen by driver and executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankframe-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str, name: str, partition_by: str | None = None,
            options: dict | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back."""
    path = f"{folder}/{name}"
    writer = df.write.options(compression="zstd", **(options or {}))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which ``small`` broadcasts; the tables given to it have short rows.
SMALL_ROWS = 20_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond
    that the planner's own choice (a shuffle join) stands. ``df`` is read
    twice, so it should be checkpointed."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df
