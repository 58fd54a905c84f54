"""Learned rankers against plain Python: gradients, trees, early stop, least squares."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.operators import lambdamart as lm
from rankframe.operators import ltr

SCHEMA = "qid string, docno string, features array<double>, label int, score double"


def plain_gradients(scores, labels, docnos, cutoff):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], docnos[i]))
    rank = {i: r for r, i in enumerate(order)}
    disc = lambda r: 1 / math.log2(r + 2) if cutoff is None or r < cutoff else 0.0
    ideal = sum(g * disc(r) for r, g in enumerate(sorted(labels, reverse=True)))
    pull, slope = [0.0] * len(scores), [0.0] * len(scores)
    for i in range(len(scores)):
        for j in range(len(scores)):
            if labels[i] > labels[j] and ideal > 0:
                swap = abs((labels[i] - labels[j]) * (disc(rank[i]) - disc(rank[j]))) / ideal
                rho = 1 / (1 + math.exp(scores[i] - scores[j]))
                pull[i] += rho * swap
                pull[j] -= rho * swap
                slope[i] += rho * (1 - rho) * swap
                slope[j] += rho * (1 - rho) * swap
    return pull, slope


def test_gradients_and_ndcg_against_plain_python():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 15)
        scores = [rng.choice([0.0, 0.5, rng.random()]) for _ in range(n)]
        labels, docnos = [rng.randint(0, 3) for _ in range(n)], [f"d{rng.randint(0, 99)}-{k}" for k in range(n)]
        cutoff = rng.choice([None, 3, 10])
        got = lm.gradients(np.array(scores), np.array(labels, dtype=float), docnos, cutoff)
        want = plain_gradients(scores, labels, docnos, cutoff)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    assert lm.ndcg(np.array([1.0, 2.0]), np.array([0.0, 1.0]), ["a", "b"]) == 1.0
    assert lm.ndcg(np.array([1.0, 1.0]), np.array([0.0, 1.0]), ["a", "b"]) == pytest.approx(1 / math.log2(3))
    assert math.isnan(lm.ndcg(np.array([1.0]), np.array([0.0]), ["a"]))


@pytest.fixture(scope="module")
def candidates(spark):
    """Relevance is a product of two features, which a linear model can't see."""
    rng = random.Random(2)
    rows = []
    for q in range(40):
        for d in range(15):
            x = [rng.uniform(-1, 1), rng.uniform(-1, 1), rng.random()]
            rows.append((f"q{q}", f"d{d}", x, 2 if x[0] * x[1] > 0.35 else 1 if x[0] * x[1] > 0.15 else 0, x[2]))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_a_tree_takes_newton_steps(spark, candidates):
    rows = lm.query_rows(candidates).mapInPandas(lm._gradient_rows(lm.LambdaMart(), 10),
                                                 "features array<double>, pull double, slope double").cache()
    tree = lm.grow(rows, 2)
    local = rows.collect()
    leaf = tree.leaves(np.array([r.features for r in local]))
    assert len(set(leaf)) > 1
    for k in set(leaf):
        at = [r for r, x in zip(local, leaf) if x == k]
        assert tree.value[k] == pytest.approx(sum(r.pull for r in at) / (sum(r.slope for r in at) + lm.SMOOTH))


def test_lambdamart_beats_the_linear_model_and_stops(spark, candidates):
    train, dev = candidates.filter(F.crc32("qid") % 3 != 0), candidates.filter(F.crc32("qid") % 3 == 0)
    model = lm.fit_lambdamart(train, dev, trees=12, patience=3)
    again = lm.fit_lambdamart(train.repartition(3), dev, trees=12, patience=3)
    assert len(model.trees) == len(again.trees) and np.allclose(model.history, again.history)
    assert 0 < len(model.trees) <= 12 and model.history[len(model.trees)] == max(model.history)
    queries = lm.query_rows(train)
    linear = ltr.apply_model(ltr.fit_pointwise(train), train).select("qid", "docno", "score")
    by_linear = lm.query_rows(train.drop("features", "score").join(linear, ["qid", "docno"])
                              .withColumn("features", F.array("score")))
    one = lm.Tree(*(np.array(x) for x in ([-1], [0.0], [0], [0], [0.0])))
    assert one.predict(np.zeros((2, 1))).tolist() == [0.0, 0.0]

    class Linear(lm.LambdaMart):
        def predict(self, x):
            return x[:, 0]
    assert lm.mean_ndcg(queries, model) > lm.mean_ndcg(by_linear, Linear()) + 0.05
    ranked = lm.apply_lambdamart(model, dev, 5).collect()
    assert {r["rank"] for r in ranked} == set(range(5)) and all(r.score_0 is not None for r in ranked)


def test_nothing_relevant_learns_nothing(spark, candidates):
    none = candidates.withColumn("label", F.lit(0))
    assert lm.fit_lambdamart(none, none).trees == ()
    assert lm.fit_lambdamart(none.limit(0)).trees == ()
    ranked = lm.apply_lambdamart(lm.LambdaMart(), candidates.filter("qid = 'q1'")).collect()
    assert [r.docno for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(r.docno for r in ranked)


def test_pointwise_model_is_least_squares(spark, candidates):
    rows = candidates.collect()
    x = np.array([[1.0, *r.features] for r in rows])
    w, *_ = np.linalg.lstsq(x, np.array([r.label for r in rows], dtype=float), rcond=None)
    want = {(r.qid, r.docno): float(np.dot(w, [1.0, *r.features])) for r in rows}
    got = ltr.apply_model(ltr.fit_pointwise(candidates), candidates).collect()
    assert len(got) == len(want)
    assert all(r.score == pytest.approx(want[r.qid, r.docno], abs=2e-6) for r in got)
