"""Dense scoring of candidates and score interpolation.

The built-in encoder is a deterministic hashed-term embedding (md5 bucket and
sign per analysed token, L2-normalised), made in the tasks that read the texts
(``counting``): a token is hashed once a batch, nothing is shuffled. A learned encoder plugs in by producing the same
``(id, vector array<double>)`` table, e.g. with ``mapInPandas``;
``operators.vectors`` stores such a table.

Dot products run in codegen'd higher-order functions; candidates (k per
query, size-checked) are broadcast into the scan of the document vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from ..session import bounded_broadcast
from .counting import hashed_vectors, joined_tokens
from .retrieve import rank_within

# --- fixed values ---------------------------------------------------------------
DIM = 64
ALPHA_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
# --- end of fixed values ----------------------------------------------------------


def encode(df: DataFrame, id_col: str, text_col: str, analyzer: Analyzer,
           dim: int = DIM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, vector array<double>, ``keep`` columns) of the texts with a vector."""
    return hashed_vectors(df.select(F.col(id_col).alias("id"), *keep,
                                    joined_tokens(analyzer, F.col(text_col)).alias("words")), dim)


def hash_sparse(df: DataFrame, id_col: str, text_col: str, analyzer: Analyzer,
                dim: int = DIM) -> DataFrame:
    """(id, dim, value): non-zero coordinates of the hashed vector of each text."""
    return (encode(df, id_col, text_col, analyzer, dim)
            .select("id", F.posexplode("vector").alias("dim", "value")).filter(F.col("value") != 0))


def encode_passages(corpus: DataFrame, run: DataFrame, analyzer: Analyzer, separator: str = "\n",
                    dim: int = DIM) -> DataFrame:
    """(docno, vector): the passages of the documents that the run holds."""
    docs = corpus.join(run.select("docno").distinct(), "docno", "left_semi")
    passages = docs.select("docno", F.explode(F.split("text", separator)).alias("passage"))
    return encode(passages, "docno", "passage", analyzer, dim).withColumnRenamed("id", "docno")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def dense_score(run: DataFrame, qvec: DataFrame, dvec: DataFrame,
                doc_key: str = "docno") -> DataFrame:
    """Candidates ⋈ vectors → score = q·d (MAXP when a document has several
    vectors: max over them); previous score kept as ``score_0``; re-ranked."""
    cand = run.select("qid", "docno", F.col("score").alias("score_0"))
    qv = qvec.select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    dv = dvec.select(F.col(doc_key).alias("docno"), F.col("vector").alias("dv"))
    j = dv.join(bounded_broadcast(cand.select("qid", "docno")), "docno").join(bounded_broadcast(qv), "qid")
    s = j.groupBy("qid", "docno").agg(F.max(dot(F.col("qv"), F.col("dv"))).alias("score"))
    # a candidate without a vector (its coordinates cancel) scores 0 and stays
    s = cand.join(s, ["qid", "docno"], "left").select(
        "qid", "docno", "score_0", F.coalesce("score", F.lit(0.0)).alias("score"))
    # + 0.0 turns a rounded -0.0 into 0.0
    return rank_within(s.withColumn("score", F.round("score", 6) + F.lit(0.0)))


# Interpolated scores keep 9 decimals: inputs carry 6, so a 6-place rounding
# would often fall exactly on a half and tie-break differently across engines.
MIX_DECIMALS = 9


def mixed(alpha: Column) -> Column:
    """α·score_0 + (1-α)·score."""
    return F.round(alpha * F.col("score_0") + (F.lit(1.0) - alpha) * F.col("score"), MIX_DECIMALS)


def interpolate(run: DataFrame, alpha: float) -> DataFrame:
    """α·score_0 + (1-α)·score, re-ranked."""
    return rank_within(run.withColumn("score", mixed(F.lit(float(alpha)))).drop("rank"))
