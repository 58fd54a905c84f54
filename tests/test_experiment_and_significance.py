"""Several runs evaluated together, and p-values for any number of queries."""

import math

import pytest
from pyspark.sql import functions as F

from rankframe.operators import evaluate as ev

# two-sided p of Student's t, from closed forms for 1, 2 and 4 degrees of freedom
CLOSED = {
    1: lambda t: 1 - 2 / math.pi * math.atan(t),
    2: lambda t: 1 - t / math.sqrt(2 + t * t),
    4: lambda t: 1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)),
}


def by_integral(t: float, nu: int, steps: int = 20_000) -> float:
    """Simpson's rule over the density between -t and t."""
    log_c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)

    def f(u: float) -> float:
        return math.exp(log_c - (nu + 1) / 2 * math.log1p(u * u / nu))
    h = t / steps
    return 1 - 2 * h / 3 * sum(f(i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))


def test_p_values_against_closed_forms_and_integration(spark):
    ts = [0.0, 0.01, 0.5, 1.0, 1.7, 1.75, 2.5, 4.0, 8.0]
    cases = [(t, nu, CLOSED[nu](t)) for nu in CLOSED for t in ts]
    cases += [(t, nu, by_integral(t, nu)) for nu in (3, 7, 50, 999, 123_456) for t in ts]
    cases += [(t, 10_000_000, math.erfc(t / math.sqrt(2))) for t in ts]  # the normal limit, to 1e-6
    df = spark.createDataFrame(cases, "t double, nu long, want double")
    for r in df.withColumn("p", ev.student_t_two_sided_p(F.col("t"), F.col("nu"))).collect():
        assert r.p == pytest.approx(r.want, abs=2e-7 if r.nu == 10_000_000 else 1e-9), r
    # the sign does not matter, and a far tail keeps its relative precision
    row = df.limit(1).select(ev.student_t_two_sided_p(F.lit(-2.5), F.lit(7)).alias("a"),
                             ev.student_t_two_sided_p(F.lit(200.0), F.lit(2)).alias("b")).first()
    assert row.a == pytest.approx(by_integral(2.5, 7), abs=1e-9)
    assert row.b == pytest.approx(2 / (math.sqrt(200 ** 2 + 2) * (math.sqrt(200 ** 2 + 2) + 200)), rel=1e-9)


@pytest.fixture(scope="module")
def runs(spark):
    schema = "qid string, docno string, score double"
    one = spark.createDataFrame([("1", "a", 3.0), ("1", "b", 2.0), ("2", "c", 1.0), ("9", "a", 1.0)], schema)
    two = spark.createDataFrame([("1", "b", 3.0), ("1", "a", 3.0), ("3", "c", 1.0)], schema)
    return {"one": one, "two": two, "none": one.limit(0)}


@pytest.fixture(scope="module")
def judgments(spark):
    return spark.createDataFrame([("1", "a", 0), ("1", "b", 2), ("2", "c", 1), ("3", "d", 1), ("4", "a", 1)],
                                 "qid string, docno string, label int")


@pytest.mark.parametrize("missing", ["drop", "zero"])
def test_runs_together_equal_runs_alone(spark, runs, judgments, missing):
    metrics = ["map", "ndcg_cut_10", "P_5", "recall_5", "recip_rank"]
    rows = ev.experiment(runs, judgments, metrics, missing=missing).collect()
    together = {(r["system"], r["metric"]): r["value"] for r in rows}
    alone = {(name, r["metric"]): r["value"] for name, run in runs.items()
             for r in ev.evaluate_run(run, judgments, metrics, missing=missing).collect()}
    assert together == pytest.approx(alone)
    # a system without any row has zeros where missing queries count, and no row otherwise
    assert (("none", "map") in together) == (missing == "zero")


def test_an_experiment_joins_its_judgments_once(spark, runs, judgments):
    def joins(some):
        plan = ev.experiment(some, judgments, ["map"], missing="drop")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join ")
    assert joins(runs) == joins({"one": runs["one"]})


def test_a_document_twice_in_one_system_fails_but_not_in_two(spark, runs, judgments):
    assert ev.experiment({"x": runs["one"], "y": runs["one"]}, judgments, ["map"]).count() == 2
    with pytest.raises(Exception, match="twice"):
        ev.experiment({"x": runs["one"].union(runs["one"])}, judgments, ["map"]).collect()
