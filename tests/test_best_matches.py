"""The k best of a batch are found inside the tasks: same rows as ranking every
(query, document), ties, negative scores, repeated and null ids included."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankframe.functions.text import STOP_ONLY
from rankframe.operators import retrieve as rt
from rankframe.operators import scoring
from rankframe.operators.index import build_index


@pytest.fixture(scope="module")
def index(spark):
    texts = [f"common word{i % 7} word{i % 5} " + "filler " * (i % 4) for i in range(120)]
    rows = [(f"d{i}", t) for i, t in enumerate(texts)] + [("copy", "common word1 word2")] * 2
    rows += [(f"c{i}", "common word1 exact copies") for i in range(60)] + [("empty", ""), ("none", None), (None, "word3")]
    return build_index(spark.createDataFrame(rows, "docno string, text string"), STOP_ONLY, positions=True)


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame(
        [("1", "common word1 exact copies"), ("2", "word3 word3 filler"), ("3", "common"), ("4", "absent"), ("5", ""),
         ("6", None), (None, "word2 common")], "qid string, query string")


def key(df):
    return sorted(((r.qid, r.docno, r.score, r["rank"]) for r in df.collect()), key=str)


def every(index, q, model, k):
    s = rt.score_matches(index, q, (model,)).select("qid", "docno", F.round(model, 6).alias("score"))
    return rt.rank_within(s, k)


@pytest.mark.parametrize("model", ["BM25", "TF_IDF", "DirichletLM", "PL2", "DPH"])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_same_rows_as_ranking_every_pair(index, topics, model, k):
    got = key(rt.retrieve(index, topics, model, k))
    assert got and got == key(every(index, rt.query_terms(topics, STOP_ONLY), model, k))


def test_small_steps_and_blocks_change_nothing(index, topics, monkeypatch):
    whole = key(rt.retrieve(index, topics, "BM25", 5))
    for name, value in (("CELLS", 10), ("MATCHES", 3), ("BUFFER_ROWS", 4), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(scoring, name, value)
    assert key(rt.retrieve(index, topics, "BM25", 5)) == whole


def test_copies_leave_a_task_k_times_at_most(spark, index, topics):
    q = rt.query_terms(topics.filter("qid = '1'"), STOP_ONLY)
    partitions = index.postings.rdd.getNumPartitions()
    assert rt.best_matches(index, q, ("BM25",), 3).count() <= 4 * partitions < rt.score_matches(index, q).count()


def test_no_row_for_every_query_and_document_moves(index, topics):
    plan = rt.best_matches(index, rt.query_terms(topics, STOP_ONLY), ("BM25",), 3)._jdf.queryExecution().executedPlan()
    outside = plan.toString().split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning(qid" not in outside and "Exchange hashpartitioning(docno" not in outside
    # postings and positions are counted where the texts were dealt to
    for table in (index.postings, index.positions):
        assert table._jdf.queryExecution().toString().count("hashpartitioning(term") == 0


def test_candidates_keep_other_documents_postings_out(spark, index, topics):
    cand = spark.createDataFrame([("1", "d1"), ("1", "c3"), ("2", "d1")], "qid string, docno string")
    q = rt.query_terms(topics, STOP_ONLY)
    full = {(r.qid, r.docno): r.BM25 for r in rt.score_matches(index, q).collect()}
    some = rt.score_matches(index, q, candidates=cand)
    assert {(r.qid, r.docno): pytest.approx(r.BM25) for r in some.collect()} == {
        p: full[p] for p in [("1", "d1"), ("1", "c3"), ("2", "d1")] if p in full}
    assert "LeftSemi" in some._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("model", ["BM25", "DirichletLM", "PL2"])
def test_shared_terms_as_matrices_and_blocks_in_one_pass(spark, topics, model, monkeypatch):
    """Products of the terms most documents and queries share are made by matrix;
    several blocks take one pass over the postings."""
    texts = [f"common word{i % 7} word{i % 5} " + "filler " * (i % 4) for i in range(300)] + ["common word1 exact copies"] * 60
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "docno string, text string").coalesce(1)
    index = build_index(docs, STOP_ONLY)
    q = rt.QueryTerms(rt.query_terms(topics, STOP_ONLY))
    want = key(every(index, q, model, 7))
    assert [len(blocks) for blocks, _ in scoring.passes([q.df, q.df.filter("qid = '1'"), q.df.filter("false")])] == [2]
    for name, value in (("BLOCK_ROWS", 4), ("CELLS", 40), ("STEP_ROWS", 20), ("WARM_DOCUMENTS", 3), ("BUFFER_ROWS", 4)):
        monkeypatch.setattr(scoring, name, value)
    assert want and key(rt.retrieve(index, topics, model, 7)) == want


def test_matrix_sums_equal_single_products():
    """A block whose shared terms are columns keeps the rows that one without keeps."""
    rng = np.random.default_rng(3)
    terms, queries = 30, 12
    n = rng.integers(1, queries, terms)
    block = scoring.Block(np.concatenate(([0], np.cumsum(n))), np.concatenate([rng.permutation(queries)[:x] for x in n]).astype(np.int32),
                          rng.integers(1, 4, n.sum()).astype(float), np.ones(queries), pa.array([f"q{i}" for i in range(queries)]))
    sizes = rng.integers(1, 15, 400)
    tid = np.concatenate([np.sort(rng.permutation(terms)[:x]) for x in sizes])
    docno, dl, base = pa.array([f"d{i}" for i in range(400)]), np.arange(400), np.zeros(400)
    for weights in (rng.random(len(tid)), rng.random(len(tid)) - 0.5):
        found = []
        for warm in (10, 10**9):
            best, at = scoring.Best(block, 5), np.concatenate(([0], np.cumsum(sizes)))
            scoring.WARM_DOCUMENTS, kept = warm, scoring.WARM_DOCUMENTS
            try:
                for i in range(0, 400, 50):
                    p = slice(at[i], at[i + 50])
                    best.add(docno.slice(i, 50), dl[i:i + 50], base[i:i + 50], sizes[i:i + 50], tid[p], [weights[p]], [False])
            finally:
                scoring.WARM_DOCUMENTS = kept
            assert (best.column is None) == (warm > 400)
            rows = pa.Table.from_batches(best.rows(["s"])).to_pylist()
            found.append(sorted((r["qid"], r["docno"], round(r["s"], 9)) for r in rows))
        assert found[0] == found[1]
