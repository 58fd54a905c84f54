"""Session helpers: building a local session for tests/bench, size-checked
broadcasts and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound under which a side of a join is broadcast. Query-side tables
# (topics, query terms, runs cut at k) are checked against it with a cheap
# count before the hint is applied; anything above falls back to a shuffle
# join that AQE may still convert at runtime.
BROADCAST_MAX_ROWS = 2_000_000


def local_session(cores: int | str = "*", partitions: int = 8,
                  app: str = "rankframe") -> SparkSession:
    """Session for tests and the bench; on a cluster use the provided one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (HDFS/object store) folder and is
    used as is; a scratch folder is created only when it is unset and the
    master is local (tests). Elsewhere each executor would see its own folder,
    so an unset name is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rankframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only if its row count is proven to be small.

    ``known_rows`` lets a caller pass a bound it already has (for example the
    count of the table a key-preserving join started from) so no extra job
    runs.
    """
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df


def round6(c):
    return F.round(c, 6)
