"""Connected components of a link table by alternating large and small stars.

Every round joins each node with the smallest node around it; edges turn into
stars around each component's smallest node in a few rounds. The per-node
minimum is pre-aggregated and written before it is joined, so both inputs of
the join are plain shuffles that adaptive execution can split where a node has
very many links. Lineage is cut in the shared checkpoint folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the
    component's smallest node. Self links and repeated links are allowed."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .filter("a <> b").distinct())
    before = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        e = checkpointed(both.filter("b > a").join(low, "a")
                         .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = checkpointed(e.groupBy("a").agg(F.min("b").alias("m")))
        hooked = e.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(hooked.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _mark(e)
        if now == before:
            break
        before = now
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
