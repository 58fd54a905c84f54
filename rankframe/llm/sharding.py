"""Sharding by a hierarchical weighted hash tree: region → rack → shard.

A document descends the tree. At each node every child draws
-ln(u) / weight, u a hash of (level, child, doc_id), and the smallest draw
wins, so a child gets its weight's part of the documents. A draw depends on
the child's own name and weight only: when a weight inside one subtree
changes, draws of the other subtrees stay, and documents move only into or
out of that subtree. Inside the other subtrees nothing moves.

``tree(n)`` is the standard tree for shards 0 to n - 1: the first
``BASE`` shards fill regions of ``RACKS`` racks with ``PER_RACK`` shards; each
later shard joins as a branch of its own, so growing by one shard adds one
branch at the top and documents move only into the new shard (law ``key``:
doc_id and shard count decide).

``assign`` gives the shard, ``numbered`` the gapless slot inside a shard.
Slots follow the document's hash, so a shard is read in shuffled order; a
shard is cut into ``CHUNKS`` ranges of that hash, only the ranges' counts meet
in one place, and rows are numbered range by range: no task gets a shard.

Defined cases: a null doc_id is placed like the empty id; equal doc_ids go to
the same shard and get different slots (order: hash, doc_id, checksum, size);
a null text has no bytes and checksum 0; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small

# --- fixed values ---------------------------------------------------------------
SHARDS = 24
BASE = 24       # shards of the base tree
PER_RACK = 2    # shards in a rack
RACKS = 3       # racks in a region
CHUNKS = 256    # ranges of the order hash inside a shard
ROW_BYTES = 8   # bytes counted for a row besides its text
# --- end of fixed values ----------------------------------------------------------


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def tree(n: int, base: int = BASE, weights: dict[int, float] | None = None) -> tuple[Node, ...]:
    """Regions of the standard tree with ``n`` shards; a node weighs as much as
    its shards."""
    if n < 1:
        raise ValueError("a tree needs a shard")
    leaf = {i: Node(f"s{i}", float((weights or {}).get(i, 1.0)), shard=i) for i in range(n)}

    def group(name: str, members: tuple[Node, ...]) -> Node:
        return Node(name, sum(m.weight for m in members), members)

    regions: list[Node] = []
    step = PER_RACK * RACKS
    first = min(n, base)
    for r in range(0, first, step):
        racks = tuple(group(f"k{k}", tuple(leaf[i] for i in range(k, min(k + PER_RACK, first))))
                      for k in range(r, min(r + step, first), PER_RACK))
        regions.append(group(f"r{r}", racks))
    for i in range(first, n):
        regions.append(group(f"r{i}+", (group(f"k{i}+", (leaf[i],)),)))
    return tuple(regions)


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def draw(doc_id: str, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u a hash of (name, doc_id), 52 bits of md5,
    strictly between 0 and 1."""
    h = F.substring(F.md5(F.concat(name, F.lit(":"), _id(doc_id))), 1, 13)
    return -F.log((F.conv(h, 16, 10).cast("double") + 0.5) / float(1 << 52)) / weight


def _literal(node: Node) -> Column:
    """A node as a constant struct; a shard's number stands for its children."""
    below = F.lit(node.shard) if node.shard is not None else F.array(*[_literal(c) for c in node.children])
    return F.struct(F.lit(node.name).alias("name"), F.lit(float(node.weight)).alias("weight"), below.alias("below"))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _winner(doc_id: str, path: Column, children: Column) -> Column:
    """The child with the smallest draw (weight 0: never)."""
    live = F.filter(children, lambda c: c["weight"] > 0)
    drawn = F.transform(live, lambda c: F.struct(
        draw(doc_id, F.concat(path, F.lit("/"), c["name"]), c["weight"]).alias("draw"), c.alias("node")))
    return F.array_min(drawn)["node"]


def shard_of(doc_id: str, regions: tuple[Node, ...]) -> Column:
    """The shard that the descent region → rack → shard reaches."""
    def shard(region: Column, rack: Column) -> Column:
        path = F.concat(F.lit("/"), region["name"], F.lit("/"), rack["name"])
        return _winner(doc_id, path, rack["below"])["below"]

    def in_region(region: Column) -> Column:
        return _bound(_winner(doc_id, F.concat(F.lit("/"), region["name"]), region["below"]),
                      lambda rack: shard(region, rack))
    return _bound(_winner(doc_id, F.lit(""), F.array(*[_literal(r) for r in regions])), in_region)


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one more shard)."""
    return (docs.withColumn("shard", shard_of(doc_id, tree(shards)).cast("int"))
            .withColumn("grown_shard", shard_of(doc_id, tree(shards + 1)).cast("int")))


def numbered(rows: DataFrame, doc_id: str = "doc_id", tie: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... inside each shard, in hash order."""
    place = F.md5(F.concat(F.lit("slot:"), _id(doc_id)))
    rows = rows.withColumn("_place", place).withColumn(
        "_chunk", F.conv(F.substring("_place", 1, 2), 16, 10).cast("int"))
    counts = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy("shard").orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0))
                           .alias("_start"))
    inside = Window.partitionBy("shard", "_chunk").orderBy("_place", doc_id, *tie)
    return (rows.withColumn("_at", F.row_number().over(inside) - 1)
            .join(small(starts), ["shard", "_chunk"])
            .withColumn("slot", (F.col("_start") + F.col("_at")).cast("long"))
            .drop("_place", "_chunk", "_at", "_start"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text and ROW_BYTES) and
    ``text_crc32``; columns of these names are replaced."""
    return (docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long"))
            .withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row."""
    slim = checkpointed(assign(measured(docs.select("doc_id", "text")).drop("text"), shards))
    return (numbered(slim, tie=("text_crc32", "size"))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"),
                    "shard", "slot", "grown_shard"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents themselves with their shard and slot."""
    own = docs.select("doc_id", F.struct(*docs.columns).alias("_row"),
                      *[F.col(c) for c in ("text",)])
    out = numbered(assign(measured(own).drop("text"), shards), tie=("text_crc32", "size"))
    keep = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep],
                      "size", "text_crc32", "shard", "slot")
