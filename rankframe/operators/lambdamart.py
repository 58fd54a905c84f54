"""Listwise learning to rank: boosted regression trees on lambda gradients.

One row holds one query with its (at most k) candidates, so gradients need no
pair rows: a task takes the candidates' scores and labels as vectors and adds
up, over the pairs of differing labels inside the query, the change of nDCG
that swapping the two would make, weighted by the logistic of their score
difference. The gradients and their slopes are the rows that an MLlib
regression tree splits; each leaf then takes a Newton step (sum of gradients
over sum of slopes). Learning stops when nDCG on the development queries has
not risen for ``patience`` trees, and the best number of trees is kept.

The query rows are written to the shared folder once. A step derives scores
from the trees so far (a few numbers that travel with the task), so nothing
grows from step to step and a lost executor repeats only its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ensure_checkpoint_dir
from .retrieve import rank_within

# --- fixed values ---------------------------------------------------------------
TREES, DEPTH, RATE, PATIENCE, CUTOFF = 30, 3, 0.1, 5, 10
SMOOTH = 1e-6          # added to a leaf's slopes
# --- end of fixed values ----------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Nodes in order; an inner node sends ``x[feature] <= threshold`` left, a
    leaf has feature -1 and its value."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            low = x[rows, self.feature[here]] <= self.threshold[here]
            at[rows] = np.where(low, self.left[here], self.right[here])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


@dataclass(frozen=True)
class LambdaMart:
    trees: tuple[Tree, ...] = ()
    rate: float = RATE
    history: tuple[float, ...] = field(default=(), compare=False)   # nDCG after each tree

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out

    def scorer(self):
        """Column function features → score."""
        model = self

        @pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            return pd.Series(model.predict(_matrix(features)) if len(features) else [], dtype="float64")
        return score


def _matrix(features) -> np.ndarray:
    return np.array([np.asarray(f, dtype=float) for f in features])


def order_of(scores: np.ndarray, docnos) -> np.ndarray:
    """Positions of the candidates by score, best first, ties by docno."""
    return np.lexsort((np.asarray(docnos, dtype=object).astype(str), -scores))


def _discounts(n: int, cutoff: int | None) -> np.ndarray:
    d = 1 / np.log2(np.arange(2, n + 2))
    if cutoff is not None:
        d[cutoff:] = 0
    return d


def ndcg(scores: np.ndarray, labels: np.ndarray, docnos, cutoff: int | None = CUTOFF) -> float:
    """nDCG of one query; nan without a relevant candidate."""
    d = _discounts(len(labels), cutoff)
    ideal = float((np.sort(labels)[::-1] * d).sum())
    return float((labels[order_of(scores, docnos)] * d).sum()) / ideal if ideal > 0 else float("nan")


def gradients(scores: np.ndarray, labels: np.ndarray, docnos, cutoff: int | None = CUTOFF) -> tuple[np.ndarray, np.ndarray]:
    """Lambda gradient and slope of every candidate of one query."""
    n = len(labels)
    ideal = float((np.sort(labels)[::-1] * _discounts(n, cutoff)).sum())
    if ideal <= 0:
        return np.zeros(n), np.zeros(n)
    discount = np.empty(n)
    discount[order_of(scores, docnos)] = _discounts(n, cutoff)
    above = labels[:, None] > labels[None, :]
    swap = np.abs((labels[:, None] - labels[None, :]) * (discount[:, None] - discount[None, :])) / ideal
    rho = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -50, 50)))
    pull = np.where(above, rho * swap, 0.0)
    slope = np.where(above, rho * (1 - rho) * swap, 0.0)
    return pull.sum(axis=1) - pull.sum(axis=0), slope.sum(axis=1) + slope.sum(axis=0)


# ------------------------------------------------------------------------- jobs
def query_rows(train: DataFrame) -> DataFrame:
    """(qid, docs): one row per query, its candidates by docno."""
    return train.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(
        "docno", F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))))
        .alias("docs"))


def _unpacked(docs) -> tuple[list, np.ndarray, np.ndarray]:
    return [d["docno"] for d in docs], _matrix([d["features"] for d in docs]), np.array([d["label"] for d in docs], dtype=float)


def _gradient_rows(model: LambdaMart, cutoff: int | None):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for docs in batch["docs"]:
                docnos, x, labels = _unpacked(docs)
                pull, slope = gradients(model.predict(x), labels, docnos, cutoff)
                yield pd.DataFrame({"features": list(x), "pull": pull, "slope": slope})
    return rows


def mean_ndcg(queries: DataFrame, model: LambdaMart, cutoff: int | None = CUTOFF) -> float | None:
    """Mean nDCG over the queries that have a relevant candidate (None: none)."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for docs in batch["docs"]:
                docnos, x, labels = _unpacked(docs)
                got.append(ndcg(model.predict(x), labels, docnos, cutoff))
            yield pd.DataFrame({"ndcg": got})
    return queries.mapInPandas(rows, "ndcg double").filter(~F.isnan("ndcg")).agg(F.avg("ndcg")).first()[0]


def _grown(fitted) -> Tree:
    """The nodes of an MLlib tree (at most 2^(depth+1) of them)."""
    nodes: list[list] = []

    def visit(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0])
        if node.subtreeDepth() > 0:
            split = node.split()
            nodes[at] = [split.featureIndex(), split.threshold(), visit(node.leftChild()), visit(node.rightChild())]
        return at
    visit(fitted._call_java("rootNode"))
    feature, threshold, left, right = (np.array(x) for x in zip(*nodes, strict=True))
    return Tree(feature.astype(np.int64), threshold.astype(float), left.astype(np.int64), right.astype(np.int64),
                np.zeros(len(nodes)))


def _leaf_sums(tree: Tree):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(tree.value), 2))
        for batch in batches:
            if len(batch):
                leaf = tree.leaves(_matrix(batch["features"]))
                np.add.at(total, leaf, batch[["pull", "slope"]].to_numpy())
        yield pd.DataFrame({"leaf": np.arange(len(total)), "pull": total[:, 0], "slope": total[:, 1]})
    return sums


def grow(rows: DataFrame, depth: int = DEPTH) -> Tree:
    """A regression tree on (features, pull, slope) with a Newton step per leaf."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor
    data = rows.select(array_to_vector("features").alias("fv"), "pull")
    tree = _grown(DecisionTreeRegressor(featuresCol="fv", labelCol="pull", maxDepth=depth, seed=1).fit(data))
    sums = (rows.mapInPandas(_leaf_sums(tree), "leaf int, pull double, slope double")
            .groupBy("leaf").agg(F.sum("pull").alias("pull"), F.sum("slope").alias("slope")).collect())  # of one tree
    for r in sums:
        tree.value[r["leaf"]] = r["pull"] / (r["slope"] + SMOOTH)
    return tree


def fit_lambdamart(train: DataFrame, dev: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH,
                   rate: float = RATE, patience: int = PATIENCE, cutoff: int | None = CUTOFF) -> LambdaMart:
    """Learn from (qid, docno, features, label) candidates. Without ``dev`` (or
    a relevant candidate in it) the training queries decide when to stop."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    queries = query_rows(train).checkpoint()
    judge = query_rows(dev).checkpoint() if dev is not None else queries
    model = LambdaMart(rate=rate)
    best = mean_ndcg(judge, model, cutoff)
    if best is None:
        judge = queries
        best = mean_ndcg(judge, model, cutoff)
    if best is None:
        return model                       # nothing relevant to learn from
    history, kept = [best], 0
    while len(model.trees) < trees and len(model.trees) - kept < patience:
        rows = queries.mapInPandas(_gradient_rows(model, cutoff), "features array<double>, pull double, slope double").persist()
        try:
            model = LambdaMart((*model.trees, grow(rows, depth)), rate)
        finally:
            rows.unpersist()
        history.append(mean_ndcg(judge, model, cutoff))
        if history[-1] > best:
            best, kept = history[-1], len(model.trees)
    return LambdaMart(model.trees[:kept], rate, tuple(history))


def apply_lambdamart(model: LambdaMart, features_run: DataFrame, k: int | None = None) -> DataFrame:
    """Re-rank candidates by the model; old score → score_0."""
    out = features_run.select("qid", "docno", F.col("score").alias("score_0"),
                              F.round(model.scorer()(F.col("features")), 6).alias("score"))
    return rank_within(out, k)
