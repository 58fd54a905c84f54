"""Hand-computed micro fixtures (metrics, fusion, cutoff, interpolation,
features, text cleaning, expansion, t-test, positions, spelling, Porter)."""

import math

import pytest
from pyspark.sql import functions as F

from rankframe.functions.text import RAW, clean_generation, jaccard, sanitize, word_set
from rankframe.operators import dense as dn
from rankframe.operators import evaluate as ev
from rankframe.operators import ltr
from rankframe.operators import rewrite as rw
from rankframe.operators.index import build_index
from rankframe.plans.algebra import Stage


def run_df(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, score double")


def qrels_df(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, label int")


def test_metrics_fixture(spark):
    run = run_df(spark, [("q1", "d1", 3.0), ("q1", "d2", 2.0), ("q1", "d3", 1.0)])
    qrels = qrels_df(spark, [("q1", "d1", 1), ("q1", "d3", 1)])
    pq = {r["metric"]: r["value"] for r in
          ev.per_query(run, qrels, ["map", "RR@10", "P_5", "recall_10", "ndcg"]).collect()}
    assert pq["map"] == pytest.approx((1 + 2 / 3) / 2)
    assert pq["RR@10"] == pytest.approx(1.0)
    assert pq["P_5"] == pytest.approx(0.4)
    assert pq["recall_10"] == pytest.approx(1.0)
    assert pq["ndcg"] == pytest.approx(1.5 / (1 + 1 / math.log2(3)), abs=1e-6)


def test_dropped_query_drop_vs_zero(spark):
    run = run_df(spark, [("q1", "d1", 3.0), ("q1", "d2", 2.0), ("q1", "d3", 1.0)])
    qrels = qrels_df(spark, [("q1", "d1", 1), ("q1", "d3", 1), ("q2", "d9", 1)])
    drop = ev.evaluate_run(run, qrels, ["map"], missing="drop").first()["value"]
    zero = ev.evaluate_run(run, qrels, ["map"], missing="zero").first()["value"]
    assert drop == pytest.approx(0.833333, abs=1e-6)
    assert zero == pytest.approx(0.416667, abs=1e-6)


def test_fusion_and_cutoff(spark):
    A = Stage(lambda t: run_df(spark, [("q1", "d1", 1.0), ("q1", "d2", 0.5)]), "A")
    B = Stage(lambda t: run_df(spark, [("q1", "d2", 2.0), ("q1", "d3", 1.0)]), "B")
    out = (2 * A + B)(None).orderBy("rank").collect()
    assert [(r["docno"], r["score"]) for r in out] == [("d2", 3.0), ("d1", 2.0), ("d3", 1.0)]
    top = ((2 * A + B) % 1)(None).collect()
    assert [r["docno"] for r in top] == ["d2"]
    tie = Stage(lambda t: run_df(spark, [("q1", "d2", 1.0), ("q1", "d1", 1.0)]), "T")
    assert [r["docno"] for r in (tie % 1)(None).collect()] == ["d1"]


def test_interpolation(spark):
    r = spark.createDataFrame([("q", "d", 10.0, 4.0)], "qid string, docno string, score_0 double, score double")
    assert dn.interpolate(r, 0.3).first()["score"] == pytest.approx(5.8)


def test_feature_union_and_ablation(spark):
    a = Stage(lambda t: spark.createDataFrame([("q", "d", 1.0, 0, [0.1, 0.2])],
                                              "qid string, docno string, score double, rank bigint, features array<double>"), "a")
    b = Stage(lambda t: run_df(spark, [("q", "d", 7.0)]), "b")
    c = Stage(lambda t: run_df(spark, [("q", "d", 9.0)]), "c")
    f = (a ** b ** c)(None).first()["features"]
    assert f == [0.1, 0.2, 7.0, 9.0]
    df = spark.createDataFrame([(f,)], "features array<double>")
    assert df.select(ltr.remove_features(F.col("features"), [0])).first()[0] == [0.2, 7.0, 9.0]
    assert df.select(ltr.keep_features(F.col("features"), [1, 3])).first()[0] == [0.2, 9.0]


def test_jaccard(spark):
    df = spark.createDataFrame([("heart disease", "Heart attack"), ("", "")], "a string, b string")
    vals = [r[0] for r in df.select(jaccard(word_set(F.col("a")), word_set(F.col("b")))).collect()]
    assert vals[0] == pytest.approx(1 / 3)
    assert vals[1] == 0.0


def test_clean_and_sanitize(spark):
    df = spark.createDataFrame([('- "wave guide"  ',), ("3d model",), ("2) x   y",), ("",)], "l string")
    got = [r[0] for r in df.select(clean_generation(F.col("l"))).collect()]
    assert got == ["wave guide", "d model", "x y", ""]
    s = spark.createDataFrame([("Title:(Élan) a_b",)], "q string").select(sanitize(F.col("q"))).first()[0]
    assert s == "title élan a_b"


def test_expansion_and_multi(spark):
    t = spark.createDataFrame([("1", "Use of use", "1. Band-pass of\n\n* use filters"),
                               ("2", "Use of use", None)], "qid string, query string, raw string")
    out = {r["qid"]: r["query"] for r in rw.expand(t).collect()}
    assert out["1"] == "use of band-pass filters"
    assert out["2"] == "Use of use"
    m = spark.createDataFrame([("1", "q", "a\nb\nc")], "qid string, query string, raw string")
    assert rw.expand_multi(m, 2).first()["query"] == "q a b"


def test_student_t_p_values(spark):
    df = spark.createDataFrame([(2.085963, 20), (12.7062, 1), (3.182446, 3), (1.986086, 92)],
                               "t double, nu int")
    ps = [r[0] for r in df.select(ev.student_t_two_sided_p(F.col("t"), F.col("nu"))).collect()]
    for p in ps:
        assert p == pytest.approx(0.05, abs=1e-6)
    b = spark.createDataFrame([(0.05,), (0.7,)], "p double").select(ev.bonferroni(F.col("p"), 2))
    assert [r[0] for r in b.collect()] == [pytest.approx(0.1), 1.0]


def test_maxp(spark):
    run = run_df(spark, [("q", "d1", 1.0), ("q", "d2", 1.0)])
    qv = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vector array<double>")
    dv = spark.createDataFrame([("d1", [0.2, 5.0]), ("d1", [0.9, 0.0]), ("d2", [0.5, 1.0])],
                               "docno string, vector array<double>")
    got = {r["docno"]: r["score"] for r in dn.dense_score(run, qv, dv).collect()}
    assert got == {"d1": 0.9, "d2": 0.5}


def test_positions_and_sdm_pairs(spark):
    corpus = spark.createDataFrame([("d", "a b a c")], "docno string, text string")
    idx = build_index(corpus, RAW, positions=True)
    pos = {r["term"]: r["pos"] for r in idx.positions.collect()}
    assert pos == {"a": [0, 2], "b": [1], "c": [3]}
    pairs = spark.createDataFrame([("o", "#1(a c)", "a", "c"), ("w", "#uw8(a b)", "a", "b")],
                                  "kind string, clause string, a string, b string")
    tf = {r["clause"]: r["tf"] for r in rw.pair_postings(idx, pairs).collect()}
    assert tf == {"#1(a c)": 1, "#uw8(a b)": 2}


def test_spelling(spark):
    corpus = spark.createDataFrame([(f"d{i}", "wave") for i in range(5)] +
                                   [(f"e{i}", "wage") for i in range(2)], "docno string, text string")
    idx = build_index(corpus, RAW)
    t = spark.createDataFrame([("1", "wabe wave zzzzzz")], "qid string, query string")
    assert rw.spell_correct(t, idx).first()["query"] == "wave wave zzzzzz"


PORTER_EXAMPLES = {
    # step 1a / 1b / 1c
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    # step 2 / 3 / 4 / 5 (full algorithm outputs)
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun",
    "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll",
    "generalizations": "gener", "oscillators": "oscil",
}


def test_porter_paper_examples(spark):
    from rankframe.functions.porter import porter_stem_frame
    df = spark.createDataFrame([(w,) for w in PORTER_EXAMPLES], "w string")
    got = {r["w"]: r["s"] for r in porter_stem_frame(df, "w", "s").collect()}
    bad = {w: (got[w], s) for w, s in PORTER_EXAMPLES.items() if got[w] != s}
    assert not bad, bad
