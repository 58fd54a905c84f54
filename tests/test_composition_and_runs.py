"""Repairs found by probing: duplicates, negative weights, caches, reopened indexes."""
import os
import random
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankframe.functions.text import STOP_ONLY
from rankframe.operators import evaluate as ev
from rankframe.operators.index import Index, build_index
from rankframe.operators import rewrite
from rankframe.operators.retrieve import query_terms, retrieve
from rankframe.plans.algebra import Feedback, Retriever, SequentialDependence, Stage, cached
from rankframe.session import ensure_checkpoint_dir
from rankframe.sources.collection import containment_qrels

RUN = "qid string, docno string, score double, rank long"


def test_duplicate_rows_are_an_error(spark):
    qrels = spark.createDataFrame([("1", "a", 1)], "qid string, docno string, label int")
    run = spark.createDataFrame([("1", "a", 2.0, 0), ("1", "a", 1.0, 1)], RUN)
    with pytest.raises(PySparkException):
        ev.per_query(run, qrels, ["map"]).collect()
    with pytest.raises(PySparkException):
        ev.per_query(run.limit(1), qrels.union(qrels), ["map"]).collect()
    kept = ev.normalize_run(run.withColumn("at", run["rank"]), order_col="at").collect()
    assert [(r.docno, r.score) for r in kept] == [("a", 1.0)]


def test_negative_weight_turns_the_order_round(spark):
    run = spark.createDataFrame([("1", "a", 2.0, 0), ("1", "b", 1.0, 1)], RUN)
    out = (-1 * Stage(lambda df: df)).transform(run).collect()
    assert {r.docno: r["rank"] for r in out} == {"b": 0, "a": 1}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("d1", "red fox jumps over dogs"), ("d2", "red red fox"), ("d3", "blue whale of the sea")],
                                 "docno string, text string")


def test_caches_of_other_cutoffs_are_apart(spark, corpus, tmp_path):
    index = build_index(corpus, STOP_ONLY)
    topics = spark.createDataFrame([("1", "red fox")], "qid string, query string")
    st = lambda k: cached(Stage(lambda t: retrieve(index, t, "BM25", k), "BM25", f"BM25@{k}"), str(tmp_path))
    assert [st(k)(topics).count() for k in (1, 2, 1)] == [1, 2, 1]


def test_reopened_index_keeps_positions(spark, corpus, tmp_path):
    path = f"file:{tmp_path}/index"
    build_index(corpus, STOP_ONLY, positions=True).write(path)
    again = Index.load(spark, path, STOP_ONLY)
    assert again.positions is not None and again.positions.count() > 0


def test_short_topics_are_judged(spark, corpus, monkeypatch):
    monkeypatch.setattr("rankframe.sources.collection.GRAM", 4)
    topics = spark.createDataFrame([("1", "red"), ("2", "of the"), ("3", "whale"), ("4", "absent"), ("5", "red unknownword fox")],
                                   "qid string, query string")
    got = {(r.qid, r.docno) for r in containment_qrels(corpus, topics, build_index(corpus, STOP_ONLY)).collect()}
    assert got == {("1", "d1"), ("1", "d2"), ("2", "d3"), ("3", "d3")}


def test_judgments_of_many_one_word_topics(spark):
    """2,000 one-word topics, short and long ones, against plain Python; no literal reaches the plan."""
    rng = random.Random(8)
    words = [f"w{k:04}" for k in range(2000)] + ["é", "日本", "a b", "x" * 40, "the end."]
    texts = {f"d{k}": " ".join(rng.choices(words, k=rng.randint(0, 30))) for k in range(300)} | {"e": "", "long": "x" * 5000}
    corpus = spark.createDataFrame([*texts.items(), ("n", None)], "docno string, text string")
    topics = [(str(k), w) for k, w in enumerate(words)] + [("none", None), ("empty", ""), ("absent", "w0001 nowhere w0002"), ("0", "w0000"),
                                                          ("blank", " \n"), ("tail", "0001 w"), ("inner", "1 w00"), ("spaced", " w0001 "),
                                                          ("three", texts["d1"][3:40]), ("line", "a b w"), ("lead", " w00")]
    frame = spark.createDataFrame(topics, "qid string, query string")
    out = containment_qrels(corpus, frame)
    assert {(r.qid, r.docno) for r in out.collect()} == {
        (q, d) for q, w in topics if w and w.strip() for d, t in texts.items() if w in t}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "w0007" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_stages_compose_after_every_operator(spark, corpus):
    index = build_index(corpus, STOP_ONLY)
    topics = spark.createDataFrame([("1", "red fox", "x"), ("2", "whale sea", "y")], "qid string, query string, extra string")
    a, b, c = (Retriever(index, m) for m in ("BM25", "TF_IDF", "PL2"))
    direct = {(r.qid, r.docno): r.score for r in (a >> c)(topics).collect()}
    for pipe in ((a + b) >> c, (a ** b) >> c, cached(a) >> c, (a % 5) >> c, 2 * a >> c, cached(a + b) >> c):
        rows = pipe(topics).collect()
        assert {(r.qid, r.docno): r.score for r in rows} == direct, pipe.name
        assert {(r.qid, r.query, r.extra) for r in rows} == {("1", "red fox", "x"), ("2", "whale sea", "y")}
    once = (a ** (a >> b) ** (a >> c))(topics).collect()
    parts = [{(r.qid, r.docno): r.score for r in p(topics).collect()} for p in (a, a >> b, a >> c)]
    assert {(r.qid, r.docno): list(r.features) for r in once} == {k: [p[k] for p in parts] for k in parts[0]}
    small = (a ** (a >> Retriever(index, "PL2", 1)))(topics).collect()   # a cutoff inside a union counts
    assert [r.features[1] for r in small if r.qid == "1"].count(0.0) == 1


def test_cutoffs_move_into_the_retriever(spark, corpus):
    index = build_index(corpus, STOP_ONLY)
    a = Retriever(index, "BM25")
    assert isinstance(a % 3, Retriever) and (a % 3).k == 3
    assert ((a >> Retriever(index, "PL2")) % 2).parts[-1].k == 2 and ((2 * a) % 2).parts[0].k == 2
    assert ((-1 * a) % 2).parts[0].parts[0].k == 1000     # the order turns: the cutoff stays outside


def test_feedback_and_dependence_are_stages(spark, corpus):
    index = build_index(corpus, STOP_ONLY, positions=True)
    topics = spark.createDataFrame([("1", "red fox")], "qid string, query string")
    a = Retriever(index, "BM25")
    for kind, terms in (("Bo1", rewrite.bo1_terms), ("RM3", rewrite.rm3_terms)):
        got = (a % 2 >> Feedback(index, kind) >> a)(topics)
        q = query_terms(topics, index.analyzer)
        want = retrieve(index, qterms=terms(index, (a % 2)(topics), q), k=1000)
        assert {(r.docno, r.score) for r in got.collect()} == {(r.docno, r.score) for r in want.collect()}
        assert "query" in got.columns
    pairs = (SequentialDependence() >> a)(topics).collect()
    plain = {r.docno: r.score for r in a(topics).collect()}
    assert {r.docno for r in pairs} == set(plain) and all(r.query == "red fox" for r in pairs)


def test_caches_tell_indexes_and_unnamed_stages_apart(spark, corpus, tmp_path):
    other = spark.createDataFrame([("z1", "red fox elsewhere"), ("z2", "nothing")], "docno string, text string")
    topics = spark.createDataFrame([("1", "red fox")], "qid string, query string")
    a, b = (cached(Retriever(build_index(c, STOP_ONLY), "BM25"), str(tmp_path)) for c in (corpus, other))
    assert {r.docno for r in a(topics).collect()} == {"d1", "d2"}
    assert {r.docno for r in b(topics).collect()} == {"z1"}
    again = cached(Retriever(build_index(corpus.repartition(2), STOP_ONLY), "BM25"), str(tmp_path))
    assert again.folder(spark) == a.folder(spark)          # the same contents: the same cache
    run = lambda d: Stage(lambda t: t.select("qid", F.lit(d).alias("docno"), F.lit(1.0).alias("score"), F.lit(0).alias("rank")))
    assert [cached(run(d), str(tmp_path))(topics).first().docno for d in ("p", "q")] == ["p", "q"]


def test_a_crashed_and_a_second_writer_leave_no_wrong_rows(spark, corpus, tmp_path):
    topics = spark.createDataFrame([("1", "red fox"), ("2", "no such thing")], "qid string, query string")
    calls = []

    def run(fail):
        def go(t):
            calls.append(t.count())
            score = F.raise_error("lost").cast("double") if fail else F.lit(1.0)
            return t.filter("qid = '1'").select("qid", F.lit("d1").alias("docno"), score.alias("score"), F.lit(0).alias("rank"))
        return cached(Stage(go, "s", "s"), str(tmp_path))
    with pytest.raises(PySparkException):
        run(True)(topics).count()                          # the queries are written, the rows are not
    assert [(r.qid, r.docno) for r in run(False)(topics).collect()] == [("1", "d1")]
    assert run(False)(topics).count() == 1 and calls == [2, 2]   # a query without rows isn't asked again
    folder = run(False).folder(spark)
    done = [f for f in os.listdir(folder) if os.path.exists(f"{folder}/{f}/rows/_SUCCESS")]
    shutil.copytree(f"{folder}/{done[0]}", f"{folder}/zz-second")   # a second writer of the same queries
    assert run(False)(topics).count() == 1


def test_scratch_folder_only_on_a_local_master(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
