"""Stored document vectors.

A vector is kept whole and as one byte a coordinate with one scale (``codes``),
in folders by a hash bucket of the document. ``scores`` reads the buckets of
the wanted documents alone. For the k best of many candidates ``best`` reads
the codes first, an eighth of the bytes: a code is off by half a scale at most,
which bounds a score from both sides, and whole vectors are read only for
candidates whose upper bound reaches the k-th lower bound. Results are those of
``dense_score``, to the last place.

Every build has its own folder and counts once its commit, written last, is
complete: a crashed build is never seen, a forced one replaces the earlier one
at once. A document may have several vectors (its best one counts); one without
any scores 0.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from ..sinks import child_folders, path_exists
from .dense import dense_score, dot
from .index import bucket_of
from .retrieve import rank_within

BUCKETS = 64
LEVELS = 127          # a code is -127 to 127
SLACK = 1e-5          # scores are rounded to 6 decimals before they are compared
COMMIT_SCHEMA = "build string, buckets int, encoder string"
VECTOR_SCHEMA = "docno string, vector array<double>, codes array<tinyint>, scale double, bucket int"


def _commits(spark: SparkSession, path: str) -> list[str]:
    return [f for f in child_folders(spark, os.path.join(path, "commits")) if path_exists(spark, f"{f}/_SUCCESS")]


def with_codes(vectors: DataFrame) -> DataFrame:
    """Add ``codes`` (array<tinyint>) and ``scale`` to (docno, vector)."""
    scale = F.array_max(F.transform("vector", lambda x: F.abs(x))) / LEVELS
    coded = F.when(F.col("scale") > 0, F.transform("vector", lambda x: F.round(x / F.col("scale")).cast("tinyint")))
    zeros = F.transform("vector", lambda x: F.lit(0).cast("tinyint"))
    return vectors.withColumn("scale", F.coalesce(scale, F.lit(0.0))).withColumn("codes", F.coalesce(coded, zeros))


@dataclass
class VectorStore:
    table: DataFrame
    buckets: int
    encoder: str
    build: str      # names the contents: a build never changes

    @staticmethod
    def write(vectors: DataFrame, path: str, encoder: str = "", buckets: int = BUCKETS,
              force: bool = False) -> None:
        """Write (docno, vector) below ``path`` and commit it. ``encoder`` names
        what made the vectors; a path with a committed build needs ``force``."""
        spark = vectors.sparkSession
        done = _commits(spark, path)
        if done and not force:
            raise FileExistsError(f"{path} holds vectors")
        build = uuid.uuid4().hex
        rows = with_codes(vectors.select(F.col("docno").cast("string").alias("docno"), "vector")
                          .filter(F.col("docno").isNotNull() & F.col("vector").isNotNull()))
        (rows.withColumn("bucket", bucket_of("docno", buckets)).repartitionByRange("bucket", "docno")
         .sortWithinPartitions("bucket", "docno").write.partitionBy("bucket")
         .parquet(os.path.join(path, "builds", build)))
        number = int(os.path.basename(done[-1]).split("-")[0]) + 1 if done else 0
        (spark.createDataFrame([(build, buckets, encoder)], COMMIT_SCHEMA).coalesce(1)
         .write.parquet(os.path.join(path, "commits", f"{number:012d}-{build}")))

    @staticmethod
    def load(spark: SparkSession, path: str, encoder: str | None = None) -> "VectorStore":
        """Reopen the last committed build; vectors of another ``encoder`` are an error."""
        done = _commits(spark, path)
        if not done:
            raise FileNotFoundError(f"{path} holds no committed vectors")
        commit = spark.read.schema(COMMIT_SCHEMA).parquet(done[-1]).first()
        if encoder is not None and encoder != commit["encoder"]:
            raise ValueError(f"{path} holds vectors of {commit['encoder']!r}, not {encoder!r}")
        table = spark.read.schema(VECTOR_SCHEMA).parquet(os.path.join(path, "builds", commit["build"]))
        return VectorStore(table, commit["buckets"], commit["encoder"], commit["build"])

    @staticmethod
    def open_or_encode(spark: SparkSession, path: str, vectors, encoder: str = "", buckets: int = BUCKETS,
                       force: bool = False) -> "VectorStore":
        """The vectors at ``path``; ``vectors()`` gives (docno, vector) if there
        are none or ``force`` is set."""
        if force or not _commits(spark, path):
            VectorStore.write(vectors(), path, encoder, buckets, force)
        return VectorStore.load(spark, path, encoder)

    def read(self, docs: DataFrame) -> DataFrame:
        """The rows of the buckets that ``docs`` (docno) fall into; at most
        ``buckets`` numbers reach the driver."""
        found = docs.select(bucket_of("docno", self.buckets).alias("bucket")).distinct().collect()
        return self.table.filter(F.col("bucket").isin([r["bucket"] for r in found])).drop("bucket")

    def scores(self, run: DataFrame, qvec: DataFrame) -> DataFrame:
        """Every candidate of the run by its vectors: ``dense_score``."""
        return dense_score(run, qvec, self.read(run).select("docno", "vector"))

    def candidates(self, run: DataFrame, qvec: DataFrame, k: int) -> DataFrame:
        """The rows of the run that can be among the k best, by codes alone;
        ties with the k-th included."""
        queries = qvec.select(F.col("id").alias("qid"), F.col("vector").alias("qv"),
                              F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + F.abs(x)).alias("length"))
        coded = self.read(run).select("docno", "codes", "scale")
        met = (coded.join(bounded_broadcast(run.select("qid", "docno")), "docno")
               .join(bounded_broadcast(queries), "qid"))
        near: Column = F.col("scale") * dot(F.col("qv"), F.col("codes"))
        off: Column = F.col("scale") / 2 * F.col("length") + SLACK
        bounds = met.groupBy("qid", "docno").agg(F.max(near - off).alias("low"), F.max(near + off).alias("high"))
        bounds = (run.join(bounds, ["qid", "docno"], "left")
                  .withColumn("low", F.coalesce("low", F.lit(0.0))).withColumn("high", F.coalesce("high", F.lit(0.0))))
        # the k highest lower bounds of a query: a limit inside each task, no whole list
        order = Window.partitionBy("qid").orderBy(F.col("low").desc())
        limits = (bounds.select("qid", "low").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
                  .groupBy("qid").agg(F.max("_n").alias("_n"), F.min("low").alias("_limit"))
                  .select("qid", F.when(F.col("_n") == k, F.col("_limit")).alias("_limit")))
        kept = bounds.join(limits, "qid").filter(F.col("_limit").isNull() | (F.col("high") >= F.col("_limit")))
        return kept.select(*run.columns)

    def best(self, run: DataFrame, qvec: DataFrame, k: int) -> DataFrame:
        """The k best of every query, scored by whole vectors."""
        return rank_within(self.scores(self.candidates(run, qvec, k), qvec).drop("rank"), k)
