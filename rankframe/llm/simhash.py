"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its word shingles'
hashes (XXH64) have it set. Two texts are linked when their fingerprints
differ in at most ``radius`` bits.

Candidates come from covering masks: bit i of the fingerprint gets a non-zero
vector m(i) of radius + 1 bits, and for every non-zero vector v the mask A(v)
keeps the bits with odd <m(i), v>. Any ``radius`` differing bits leave some v
orthogonal to all their vectors, so every linked pair agrees on all bits of
some mask: no pair is lost, whatever the data (2^(radius+1) - 1 tables).

Equal fingerprints are merged first, so copies never form pairs. Rows of a
table that agree under its mask form a bucket. Inside a bucket only a
spanning forest of the links is emitted, at most one link per member. A
bucket above ``BUCKET`` members is cut again by covering masks over the bits
that its members may still differ in; every cut keeps more bits (about half
of them), down to 2^7 possible fingerprints, so the cuts end whatever the
input. Links go to connected components.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; fewer words than a shingle give one shingle of them all; a component
is named by its smallest doc_id (null only if it has no other), so components
of null ids, or of one id with several texts, may share a name and stay
apart; repeated rows are equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import checkpointed
from .components import components

# --- fixed values ---------------------------------------------------------------
SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
BUCKET = 2048
# --- end of fixed values ----------------------------------------------------------

_STEP = 1 << 16  # shingles whose bits are counted at once


def simhash(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        value = xxhash.xxh64_intdigest(b" ".join(words), seed)
        return value - (1 << 64) if value >> 63 else value
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _STEP):
        h = np.array([digest(joined[a:b], seed)
                      for a, b in zip(starts[at:at + _STEP], ends[at:at + _STEP], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(width: int = SHINGLE, seed: int = SEED):
    """Column function text → fingerprint (long)."""
    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width, seed) for t in texts], dtype="int64")
    return fp


def hex16(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------ candidates
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, free: int = (1 << BITS) - 1) -> list[int]:
    """Masks over the bits of ``free``; any ``radius`` of them are all left out
    by some mask. The unit vectors are dealt first, so with more than
    ``radius`` free bits every mask keeps at least one of them."""
    n = (1 << (radius + 1)) - 1
    vectors = sorted(range(1, n + 1), key=lambda m: (m.bit_count() > 1, m))
    bits = [i for i in range(BITS) if free >> i & 1]
    vector = {b: vectors[k % n] for k, b in enumerate(bits)}
    return [_signed(sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1)) for v in range(1, n + 1)]


def _next_masks(radius: int):
    @pandas_udf("array<long>")
    def masks(kept: pd.Series) -> pd.Series:
        full, known = (1 << BITS) - 1, {}
        for k in kept.unique():
            known[k] = list({_signed((int(k) & full) | (m & full))
                             for m in covering_masks(radius, full & ~(int(k) & full))})
        return kept.map(known)
    return masks


def _forest(radius: int):
    @pandas_udf("array<struct<a:long,b:long>>")
    def forest(buckets: pd.Series) -> pd.Series:
        """A spanning forest of the links among each bucket's fingerprints."""
        out = []
        for members in buckets:
            left = np.sort(np.asarray(members, dtype=np.int64))
            links = []
            while len(left) > 1:
                reached, left = [left[0]], left[1:]
                while reached and len(left):
                    u = reached.pop()
                    near = np.bitwise_count((left ^ u).view(np.uint64)) <= radius
                    found = left[near]
                    links += [{"a": int(u), "b": int(x)} for x in found]
                    reached += found.tolist()
                    left = left[~near]
            out.append(links)
        return pd.Series(out)
    return forest


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps`` (fp) that join all
    within ``radius`` of each other; every link is checked."""
    if bucket < 128:
        raise ValueError("a bucket that can't be cut further may hold 128 fingerprints")
    forest, more = _forest(radius), _next_masks(radius)
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    rows = fps.select("fp", F.explode(masks).alias("kept"))
    found = None
    while True:
        rows = rows.select("fp", "kept", F.col("fp").bitwiseAND(F.col("kept")).alias("key"))
        groups = checkpointed(rows.groupBy("kept", "key").agg(
            F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"))
        pairs = groups.filter((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)) \
            .select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        several = groups.filter((F.col("n") > 2) & (F.col("n") <= bucket)).select("kept", "key")
        inside = (rows.join(several, ["kept", "key"]).groupBy("kept", "key")
                  .agg(F.collect_list("fp").alias("m"))  # at most `bucket` members
                  .select(F.inline_outer(forest("m"))).filter("a IS NOT NULL"))  # outer: evaluated once
        new = pairs.unionByName(inside)
        found = new if found is None else found.unionByName(new)
        large = groups.filter(F.col("n") > bucket).select("kept", "key")
        if large.isEmpty():
            return found
        rows = checkpointed(rows.join(large, ["kept", "key"])
                            .select("fp", F.explode(more("kept")).alias("kept")).distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id for every row; ``root``, a
    fingerprint, tells the components apart, which component_id may not."""
    own = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                                   fingerprint(width)("text").alias("fp")))
    fps = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(fps, radius))
    named = checkpointed(fps.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    names = checkpointed(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    by_fp = checkpointed(named.join(names, "root").select("fp", "root", "component_id"))
    return own.join(by_fp, "fp")


def keep_first(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: of those with its smallest
    doc_id the one with the smallest text hash."""
    found = near_duplicates(docs, width, radius)
    kept = checkpointed(found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("r"))
        .select(F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash"), F.lit(1).alias("_one")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc_id"),
                       F.xxhash64("text").alias("_text_hash"))
    one = Window.partitionBy("_text_hash", "_doc_id").orderBy(F.to_json("_row"))
    return (rows.join(kept, (F.col("_text_hash") == F.col("_hash")) & F.col("_doc_id").eqNullSafe(F.col("_id")), "left_semi")
            .withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*"))
