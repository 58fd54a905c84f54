"""Mixing sources to target weights.

Words are summed per source; sources in code-point order (null last) share
``share`` times all words by their weights. A source's target stops at
``limit`` times its own words and the excess is shared again by weight until
no target is above its limit. A source's rate is target / words: each
document is emitted floor(rate) times, plus one copy when its hash-seeded draw
falls in the remaining fraction.

The draw of a document is a hash of (seed, doc_id). Drawn independently, a
few long documents would throw a small source far off its target, so the
threshold on the draws is read from their word-weighted distribution: the
draws are cut into ``CELLS`` cells per source, the words of the cells
summed, and the copy goes to the cells from 0 up whose words come nearest to
fraction x words. What is then still missing or too much is mended by the at
most ``MENDS`` cells that fit it best. A document's place among the draws is a hash, so each
has about the fraction as its probability, and the realised words follow the
target as closely as whole cells allow.

Only per-document numbers (no text) are shuffled, pre-aggregated per
(source, cell); the cells of a source are at most ``CELLS`` rows.

Defined cases: a null or empty text has size 0; a null source is a source of
its own, last in order; a source without words has target 0; a null doc_id
draws like the empty id; repeated rows draw alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small, word_count

# --- fixed values ---------------------------------------------------------------
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
CELLS = 4096
MENDS = 3
SEED = "mix-1"
# --- end of fixed values ----------------------------------------------------------


def draw_cell(doc_id, seed: str = SEED) -> Column:
    """The cell (0 to CELLS - 1) of a document's hash-seeded draw."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % CELLS


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE,
            limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    The level L with sum(min(w L, limit size)) = share x all words is found
    in closed form: sources ordered by limit size / w reach their limit first,
    and the level of the rest follows from what is left.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w"),
                     (F.col("source_size") * F.lit(limit)).alias("cap"),
                     F.sum("source_size").over(Window.partitionBy()).alias("all"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if this source and all later ones were below their limits
    level = ((F.col("all") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("w").over(after))
    per = per.withColumn("level", level)
    per = per.withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    per = per.withColumn("first_level", F.min(F.when(F.col("free"), F.struct(
        F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy()))
    target = F.least("cap", F.coalesce(F.col("first_level.level") * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, cell), computed once and kept in the shared folder."""
    return checkpointed(docs.select("doc_id", "source", word_count("text").alias("size"),
                                    draw_cell("doc_id", seed).alias("cell")))


def plan(sized: DataFrame, **options) -> DataFrame:
    """(source, source_size, target, copies, cut, flips): every document of a
    source is taken ``copies`` times, and once more if its draw cell is below
    ``cut``; for the cells in ``flips`` it is the other way round."""
    goal = targets(sized, **options)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = (goal.withColumn("copies", F.floor(rate).cast("long"))
            .withColumn("want", F.col("target") - F.col("copies") * F.col("source_size")))
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("cell")
    c = checkpointed(cells.withColumn("upto", F.sum("words").over(run))).alias("c")
    near = F.struct(F.abs(F.col("upto") - F.col("want")).alias("off"), "upto",
                    (F.col("cell") + 1).alias("cut"))
    best = (goal.alias("g").join(c, F.col("g.source").eqNullSafe(F.col("c.source")), "left")
            .groupBy("g.source", "source_size", "target", "copies", "want")
            .agg(F.min(near).alias("near")))
    taken = F.col("near.off") < F.col("want")  # else the nearest is to take none
    best = best.select("source", "source_size", "target", "copies",
                       F.when(taken, F.col("near.cut")).otherwise(0).cast("long").alias("cut"),
                       (F.col("want") - F.when(taken, F.col("near.upto")).otherwise(0)).alias("left"))
    best = best.withColumn("flips", F.array().cast("array<long>"))
    for _ in range(MENDS):
        words = F.when(F.col("cell") < F.col("cut"), -F.col("words")).otherwise(F.col("words"))
        swap = F.struct(F.abs(F.col("left") - words).alias("off"), F.col("cell").alias("cell"), words.alias("words"))
        fresh = F.col("g.source").eqNullSafe(F.col("c.source")) & ~F.array_contains("flips", F.col("cell"))
        tried = (checkpointed(best).alias("g").join(c, fresh, "left")
                 .groupBy("g.source", "source_size", "target", "copies", "cut", "left", "flips")
                 .agg(F.min(swap).alias("swap")))
        better = F.col("swap.off") < F.abs("left")
        best = tried.select("source", "source_size", "target", "copies", "cut",
                            F.when(better, F.col("left") - F.col("swap.words")).otherwise(F.col("left")).alias("left"),
                            F.when(better, F.array_append("flips", F.col("swap.cell").cast("long")))
                            .otherwise(F.col("flips")).alias("flips"))
    return checkpointed(best.drop("left"))


def _n_copies() -> Column:
    return F.col("copies") + ((F.col("cell") < F.col("cut")) != F.array_contains("flips", F.col("cell"))).cast("long")


def _with_plan(df: DataFrame, planned: DataFrame) -> DataFrame:
    """Null-safe join with the plan: one row per source, broadcast when it has
    few rows and left to a shuffle join beyond that."""
    p = planned.select(F.col("source").alias("_source"), "source_size", "target", "copies", "cut", "flips")
    return df.join(small(p), F.col("source").eqNullSafe(F.col("_source")), "left")


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Per document: size, source_size, target, n_copies, taken."""
    sized = sizes(docs, seed)
    return (_with_plan(sized, plan(sized, **options))
            .withColumn("n_copies", _n_copies())
            .select("doc_id", "size", "source_size", "target", "n_copies",
                    (F.col("n_copies") * F.col("size")).alias("taken")))


def emit(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    planned = plan(sizes(docs, seed), **options)
    own = docs.select(F.struct(*docs.columns).alias("_row"), "source",
                      draw_cell("doc_id", seed).alias("cell"))
    return (_with_plan(own, planned)
            .select("_row", F.explode(F.array_repeat(F.lit(1), _n_copies().cast("int"))))
            .select("_row.*"))
