"""Terms are counted and vectors made in the tasks that read the texts: no
exchange, rows with one id brought together, documents cut by batches kept whole."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from rankframe.functions.text import STOP_ONLY
from rankframe.operators import counting, dense
from rankframe.operators import retrieve as rt
from rankframe.operators.index import Index, build_index
from rankframe.sources.collection import containment_qrels

ROWS = [("a", "cat dog cat"), ("b", "the dog"), ("b", "dog bird"), ("b", "cat cat dog"), ("c", "cat dog"), ("c", "dog cat"),
        ("e", ""), ("n", None), (None, "cat"), (None, "bird"), ("s", "the of")]


def words(text):
    return [w for w in (text or "").split() if w not in ("the", "of")]


def expected():
    """(term, docno, dl) -> positions, by plain Python."""
    out = defaultdict(list)
    for docno, text in ROWS:
        for p, w in enumerate(words(text)):
            out[w, docno, len(words(text))].append(p)
    return {k: sorted(v) for k, v in out.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "docno string, text string")


@pytest.mark.parametrize("step", [1, 16_000_000])
def test_postings_and_positions_with_repeated_ids(corpus, monkeypatch, step):
    monkeypatch.setattr(counting, "STEP_BYTES", step)
    index = build_index(corpus, STOP_ONLY, positions=True)
    assert {(r.term, r.docno, r.dl): r.tf for r in index.postings.collect()} == {k: len(v) for k, v in expected().items()}
    assert {(r.term, r.docno, r.dl): r.pos for r in index.positions.collect()} == expected()
    assert index.postings.count() == len(expected())


def test_distinct_ids_are_counted_where_they_are_read(spark):
    corpus = spark.createDataFrame([(f"d{i}", f"cat w{i}") for i in range(50)], "docno string, text string")
    index = build_index(corpus, STOP_ONLY, positions=True, persist=False)
    for table in (index.postings, index.positions):
        assert "Exchange" not in plan(table) and "Aggregate" not in plan(table)
    assert index.by_document and "num_terms" not in index.stats     # the vocabulary isn't counted unasked
    assert index.stats["num_terms"] == 51 and index.stats["num_postings"] == 100
    some = index.read("lexicon", spark.createDataFrame([("cat",), ("w3",), ("none",)], "term string"))
    assert {(r.term, r.df, r.cf) for r in some.collect()} == {("cat", 50, 50), ("w3", 1, 1)}


def test_documents_cut_by_batches_stay_whole(spark, corpus, tmp_path):
    index = build_index(corpus, STOP_ONLY, positions=True)
    stored = Index.open_or_build(corpus, f"file:{tmp_path}/i", STOP_ONLY, positions=True, buckets=4)
    topics = spark.createDataFrame([("1", "cat dog bird"), ("2", "dog")], "qid string, query string")
    run = lambda i: sorted(((r.qid, r.docno, r.score, r["rank"]) for r in rt.retrieve(i, topics, "DirichletLM", 9).collect()), key=str)
    q = rt.query_terms(topics, STOP_ONLY)
    every = {(r.qid, r.docno, round(r.DirichletLM, 6)) for r in rt.score_matches(index, q, ("DirichletLM",)).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
        one = run(index)
        assert one == run(stored)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(q, d, round(s, 6)) for q, d, s, _ in one} == every


def test_a_stored_build_tokenises_once_and_keeps_one_table_by_term(spark, corpus, tmp_path):
    stored = Index.open_or_build(corpus, f"file:{tmp_path}/i", STOP_ONLY, positions=True, buckets=4)
    build = next((tmp_path / "i" / "builds").iterdir())
    assert not (build / "positions").exists()       # positions are a column of the postings
    assert {(r.term, r.docno, r.dl): r.pos for r in stored.positions.collect()} == expected()
    assert {(r.term, r.docno, r.dl): r.tf for r in stored.read("direct", corpus).collect()} == {k: len(v) for k, v in expected().items()}
    assert stored.stats["num_terms"] == 3 and stored.stats["num_postings"] == len(expected())


def test_vectors_against_plain_python(spark):
    texts = [("1", "cat dog cat ciónue"), ("2", ""), ("3", None), ("4", "the"), ("5", "dog " * 7)]
    found = dense.encode(spark.createDataFrame(texts, "docno string, text string"), "docno", "text", STOP_ONLY)
    assert "MapInArrow" in plan(found) and "Exchange" not in plan(found)
    want = {}
    for docno, text in texts:
        v = [0.0] * dense.DIM
        for w, n in Counter(words(text)).items():
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:4], 16) % dense.DIM] += -n if int(h[4], 16) % 2 else n
        if any(v):
            norm = math.sqrt(sum(x * x for x in v))
            want[docno] = [x / norm for x in v]
    assert {r.id: r.vector for r in found.collect()} == want


def test_judgments_leave_the_texts_where_they_are(spark):
    corpus = spark.createDataFrame([("a", "one two three"), ("b", "two three four")], "docno string, text string")
    topics = spark.createDataFrame([("1", "one two three"), ("2", "three four")], "qid string, query string")
    judged = containment_qrels(corpus, topics)
    assert {(r.qid, r.docno) for r in judged.collect()} == {("1", "a"), ("2", "b")}
    outside = plan(judged).split("InMemoryRelation")[0]
    assert "SortMergeJoin" not in outside and "BroadcastHashJoin" in outside
