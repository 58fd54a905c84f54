"""Source divergence audit by ranked count cells.

Which words set a source apart from the other texts of its language, and how
far are two sources of a language from each other? Terms are runs of letters
and non-ASCII characters; a language keeps the terms that stand in at least
``MIN_DOCS`` of its documents. A group (lang, source) gives a term that it
holds ``count`` times the smoothed share p = 1 + floor(SCALE * (count + 2) /
(N + 2 V)), N being the group's occurrences of the V kept terms; a language
likewise gives q. The divergence of two shares is floor((p - q)² / (p + q)),
all in whole numbers (decimals where a product may pass 64 bits).

*Terms of a group.* The divergence depends on the counts alone, so terms are
grouped into cells by (group count, lang count) and f is evaluated once per
cell. Equal values of several cells are merged, values are ranked by the
cumulative number of terms above them, and only cells that begin within the
wanted ranks are expanded into terms, in UTF-8 order.

*Pairs of groups.* A kept term is one vector of (source, count). Vectors are
dealt by a hash over as many salts as the number of counts asks for, and each
task adds up the divergences of ``SOURCES`` sources against all of the
language, chunk by chunk in NumPy, so that a task sends sums and no pair of a
single term.

Terms are counted inside the tasks that read the texts, so that only counts by
(lang, source number, term) move, and they move once, by (lang, term): adding
them up, keeping the terms of enough documents and gathering a term's vector
all use that partitioning. A row of that shuffle stands for one term of one
source in one task, however often the term occurs.

Defined cases: a null text, lang or source is empty; a group without kept
terms takes part in pairs with count 0 for each of them; a language without
kept terms gives its pairs the value 0; repeated rows count each; a null
doc_id needs no care, as ids are not read; ties have their items in UTF-8
order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small

# --- fixed values ---------------------------------------------------------------
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
HELD = 300_000         # distinct terms that a task gathers before it hands them on
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10               # ranks of the terms of a group
SOURCES = 32           # sources that one task compares with all of the language
SALT_COUNTS = 500_000  # counts of one salt, about
CHUNK = 2_000_000      # shares that a task compares at once
# --- end of fixed values ----------------------------------------------------------


_COUNTED = "lang string, source string, term string, n long, docs long"


def _rows(counts: dict) -> pd.DataFrame:
    frames = [pd.DataFrame({"lang": lang, "source": source, "term": [t.decode() for t in n], "n": list(n.values()),
                            "docs": [docs[t] for t in n]}) for (lang, source), (n, docs) in counts.items()]
    return pd.concat(frames) if frames else pd.DataFrame(columns=[c.split()[0] for c in _COUNTED.split(", ")])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of each term, per (lang, source), of a task's
    documents; handed on whenever HELD of them are gathered."""
    counts, held = {}, 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            # bytes.lower changes A-Z alone, and all bytes of non-ASCII characters are above 0x7F
            terms = _TERM.findall(text.encode().lower())
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held > HELD:
                yield _rows(counts)
                counts, held = {}, 0
    yield _rows(counts)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents
    with it, as counted by each task (not yet added up)."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInPandas(_count, _COUNTED)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms))."""
    above = (count + 2).cast("decimal(20,0)") * F.lit(SCALE)
    below = F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)")
    return _div(above, below) + 1


def _div(a: Column, b: Column) -> Column:
    """Whole part of a / b, exactly."""
    return ((a - a % b) / b).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)² / (p + q)); shares are at most SCALE + 1, so 64 bits do."""
    return _div(((p - q) * (p - q)).cast("decimal(20,0)"), (p + q).cast("decimal(20,0)"))


class Audit:
    """Vectors of the kept terms, checkpointed, and the sizes around them."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = checkpointed(groups.withColumn("number", number))
        counts = (counted(docs).join(small(groups), ["lang", "source"]).repartition("lang", "term")
                  .groupBy("lang", "term", "number").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        self.vectors = checkpointed(
            counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"),
                                               F.collect_list(F.struct("number", "n")).alias("vector"))
            .filter(F.col("docs") >= min_docs).drop("docs"))
        self.held = self.vectors.select("lang", "term", "lang_n", F.inline("vector"))
        # every kept term stands in some group, so the vectors tell V and both N
        langs = self.vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = self.held.groupBy("lang", "number").agg(F.sum("n").alias("total"))
        sized = groups.join(langs, "lang", "left").join(totals, ["lang", "number"], "left").na.fill(
            0, ["v", "lang_total", "total"])
        self.sizes = checkpointed(sized.withColumn(
            "p0", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(1))))


def term_part(audit: Audit, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more."""
    cells = (audit.held.groupBy("lang", "number", "n", "lang_n").agg(F.count("*").alias("terms"))
             .join(small(audit.sizes.drop("source", "p0")), ["lang", "number"])
             .withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
             .withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
             .filter(F.col("p") > F.col("q")).withColumn("value", divergence(F.col("p"), F.col("q")))
             .select("lang", "number", "n", "lang_n", "value", "terms"))
    better = (Window.partitionBy("lang", "number").orderBy(F.desc("value"))
              .rowsBetween(Window.unboundedPreceding, -1))
    values = (cells.groupBy("lang", "number", "value").agg(F.sum("terms").alias("terms"))
              .withColumn("above", F.coalesce(F.sum("terms").over(better), F.lit(0)))
              .filter(F.col("above") < top).drop("terms"))
    wanted = checkpointed(cells.drop("terms").join(values, ["lang", "number", "value"]))
    order = Window.partitionBy("lang", "number").orderBy(F.desc("value"), "term")
    return (audit.held.join(small(wanted), ["lang", "number", "n", "lang_n"])
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .join(small(audit.sizes.select("lang", "number", "source")), ["lang", "number"])
            .select("lang", "source", F.col("term").alias("item"), "value", "rank"))


def shares_of(counts: np.ndarray, totals: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """``share`` in a task: 64 bits while the product fits, whole Python numbers beyond."""
    if len(counts) and counts.max() >= (1 << 63) // SCALE - 2:
        return np.array([1 + SCALE * (int(n) + 2) // (int(t) + 2 * int(v))
                         for n, t, v in zip(counts, totals, terms, strict=True)], dtype=np.int64)
    return 1 + SCALE * (counts + 2) // (totals + 2 * terms)


def compare(vectors: pd.DataFrame, sources: pd.DataFrame, sources_at_once: int = SOURCES) -> pd.DataFrame:
    """Summed divergences of the sources of the block against all of the
    language; a term's vector has the ``numbers`` of its sources and its
    ``counts`` there."""
    sources = sources.sort_values("number")
    base = sources["p0"].to_numpy(dtype=np.int64)
    totals, kept = (sources[c].to_numpy(dtype=np.int64) for c in ("total", "v"))
    own = np.flatnonzero(sources["number"].to_numpy() // sources_at_once == sources["block"].iloc[0])
    sums = np.zeros((len(own), len(base)), dtype=np.int64)
    step = max(1, CHUNK // max(1, sums.size))
    for start in range(0, len(vectors), step):
        part = vectors.iloc[start:start + step]
        p = np.tile(base, (len(part), 1))
        rows = np.repeat(np.arange(len(part)), [len(x) for x in part["numbers"]])
        at = np.concatenate(part["numbers"].to_list()).astype(np.int64)
        counts = np.concatenate(part["counts"].to_list()).astype(np.int64)
        p[rows, at] = shares_of(counts, totals[at], kept[at])
        mine, every = p[:, own, None], p[:, None, :]
        sums += ((mine - every) ** 2 // (mine + every)).sum(axis=0)
    at = np.repeat(own, len(base))
    return pd.DataFrame({"a": sources["number"].to_numpy()[at], "b": np.tile(sources["number"], len(own)),
                         "value": sums.ravel()})


def _sums(key: tuple, vectors: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    lang = key[0]
    if not len(sources):
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
    out = compare(vectors, sources)
    out.insert(0, "lang", lang)
    return out[out["a"] != out["b"]]


def pair_part(audit: Audit) -> DataFrame:
    """(lang, source, item, value, rank): the other sources of the language,
    farthest first."""
    entries = audit.vectors.agg(F.sum(F.size("vector"))).first()[0] or 0
    salts = max(1, -(-entries // SALT_COUNTS))
    blocks = audit.sizes.groupBy("lang").agg(F.floor(F.max("number") / SOURCES).alias("last"))
    left = (audit.vectors.join(small(blocks), "lang")
            .select("lang", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"),
                    F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"),
                    F.col("vector.number").alias("numbers"), F.col("vector.n").alias("counts")))
    right = (audit.sizes.join(blocks, "lang")
             .select("lang", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), "number", "p0",
                     "total", "v")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    keys = ("lang", "block", "salt")
    sums = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInPandas(_sums, "lang string, a int, b int, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    names = audit.sizes.select("lang", "number", "source")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (sums.join(names.withColumnRenamed("number", "a"), ["lang", "a"])
            .join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
            .withColumn("rank", F.row_number().over(order)).select("lang", "source", "item", "value", "rank"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    audit = Audit(docs, min_docs)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (pair_part(audit).withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(term_part(audit, top).withColumn("part", F.lit("term")).select(*columns)))
