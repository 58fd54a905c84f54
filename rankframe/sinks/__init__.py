"""Sinks: result and metric CSVs, TREC run files, reuse/overwrite policy."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in ``path``, by name; none if it is missing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.isDirectory())


def save_results(run: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Run → CSV with header (one directory, no index column)."""
    run.write.mode(mode).option("header", True).csv(path)
    return path


def trec_lines(run: DataFrame, tag: str) -> DataFrame:
    """``qid Q0 docno rank score tag`` lines (score with 6 decimals)."""
    return run.select(F.concat_ws(" ", "qid", F.lit("Q0"), "docno", F.col("rank").cast("string"),
                                  F.format_string("%.6f", F.col("score")), F.lit(tag)).alias("line"))


def save_trec_run(run: DataFrame, save_dir: str, name: str, save_mode: str = "reuse") -> DataFrame:
    """Persist a run per system; ``reuse`` (default) reads an existing run
    instead of recomputing, ``overwrite`` rewrites it."""
    spark = run.sparkSession
    path = os.path.join(save_dir, name)
    if save_mode == "reuse" and path_exists(spark, path):
        return read_trec_run(spark, path)
    trec_lines(run, name).write.mode("overwrite").text(path)
    return read_trec_run(spark, path)


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).select(
        parts[0].alias("qid"), parts[2].alias("docno"), parts[3].cast("bigint").alias("rank"),
        parts[4].cast("double").alias("score"))


def write_metrics_csv(metrics_long: DataFrame, order: list[str], path: str,
                      mode: str = "overwrite") -> str:
    """(metric, value) → one-row CSV, columns in ``order``."""
    one = metrics_long.groupBy().pivot("metric", order).agg(F.first("value"))
    one.coalesce(1).write.mode(mode).option("header", True).csv(path)
    return path


def write_metrics_if_absent(metrics_long: DataFrame, order: list[str], path: str) -> bool:
    """Stub writer: only writes when no file exists yet; returns whether it
    wrote."""
    if path_exists(metrics_long.sparkSession, path):
        return False
    write_metrics_csv(metrics_long, order, path, mode="errorifexists")
    return True


def read_metrics_csv(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """One-row metrics CSV → (metric, value), explicit DOUBLE schema."""
    schema = ", ".join(f"`{m}` double" for m in order)
    one = spark.read.schema(schema).option("header", True).csv(path)
    stack = "stack({n}, {args}) as (metric, value)".format(
        n=len(order), args=", ".join(f"'{m}', `{m}`" for m in order))
    return one.selectExpr(stack)
