"""Learning to rank over candidate runs.

Features are columns computed per (qid, docno) candidate (array<double>);
the training set is the candidates left-joined to judgments (absent = 0);
the pointwise model is an MLlib regressor on ``array_to_vector(features)``,
and re-ranking is the usual per-query window. Feature ablation trains one
model per removed feature and evaluates all resulting runs in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, word_set
from .retrieve import rank_within


def doc_fields(corpus: DataFrame) -> DataFrame:
    """Fielded view of a plain corpus: title = first line, abstract = the
    whole text, plus the stored character count."""
    return corpus.select("docno", F.split(F.col("text"), "\n").getItem(0).alias("title"),
                         F.col("text").alias("abstract"), "n_chars")


def jaccard_features(run: DataFrame, topics: DataFrame, fields: DataFrame) -> DataFrame:
    """(qid, docno, j_title, j_abstract): token sets are built once per query
    and once per candidate document before the join."""
    qs = topics.select("qid", word_set(F.col("query")).alias("qset"))
    cand_docs = run.select("docno").distinct()
    ds = (fields.join(cand_docs, "docno", "left_semi")
          .select("docno", word_set(F.col("title")).alias("tset"),
                  word_set(F.col("abstract")).alias("aset")))
    j = run.select("qid", "docno").join(qs, "qid").join(ds, "docno")
    return j.select("qid", "docno", jaccard(F.col("qset"), F.col("tset")).alias("j_title"),
                    jaccard(F.col("qset"), F.col("aset")).alias("j_abstract"))


def remove_features(features, drop_ids: list[int]):
    ids = F.array(*[F.lit(i) for i in drop_ids])
    return F.filter(features, lambda x, i: ~F.array_contains(ids, i))


def keep_features(features, keep_ids: list[int]):
    ids = F.array(*[F.lit(i) for i in keep_ids])
    return F.filter(features, lambda x, i: F.array_contains(ids, i))


def training_set(features_run: DataFrame, qrels: DataFrame) -> DataFrame:
    q = qrels.select("qid", "docno", "label")
    return features_run.join(q, ["qid", "docno"], "left").withColumn(
        "label", F.coalesce(F.col("label"), F.lit(0)))


def fit_pointwise(train: DataFrame, max_iter: int = 50, reg: float = 0.0):
    """Standardised linear regression of label on features (MLlib)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = train.select(array_to_vector("features").alias("fv"),
                        F.col("label").cast("double").alias("label"))
    pipe = Pipeline(stages=[
        StandardScaler(inputCol="fv", outputCol="fs", withMean=True, withStd=True),
        LinearRegression(featuresCol="fs", labelCol="label", maxIter=max_iter,
                         regParam=reg, solver="normal")])
    return pipe.fit(data)


def apply_model(model, features_run: DataFrame, k: int | None = None) -> DataFrame:
    """Re-rank candidates by the model prediction; old score → score_0."""
    from pyspark.ml.functions import array_to_vector
    x = features_run.withColumn("fv", array_to_vector("features"))
    p = model.transform(x)
    out = p.select("qid", "docno", F.col("score").alias("score_0"),
                   F.round(F.col("prediction"), 6).alias("score"))
    return rank_within(out, k)
