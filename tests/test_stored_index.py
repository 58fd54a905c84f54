"""The stored index: buckets read, direct index, commits, crashed and forced
builds, positions asked for later, odd corpora."""
import pytest

from rankframe.functions.text import STOP_ONLY
from rankframe.operators import index as ix
from rankframe.operators.index import Index, build_index
from rankframe.operators.retrieve import retrieve
from rankframe.operators.rewrite import _feedback_bags
from rankframe.plans.algebra import Feedback, Retriever, SequentialDependence

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]


def text(n):
    return " ".join(WORDS[(n * 7 + k * k) % len(WORDS)] for k in range(30)) + " common" * (n % 3 + 1)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"d{n}", text(n)) for n in range(120)] + [("empty", ""), ("null", None)]
    return spark.createDataFrame(rows, "docno string, text string")


@pytest.fixture(scope="module")
def memory(corpus):
    return build_index(corpus, STOP_ONLY, positions=True)


@pytest.fixture(scope="module")
def stored(spark, memory, tmp_path_factory):
    path = f"file:{tmp_path_factory.mktemp('index')}/i"
    memory.write(path, buckets=32)
    return Index.load(spark, path, STOP_ONLY)


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame([("1", "waa common"), ("2", "wbc wbc wtj missing"), ("3", ""), ("4", "common")],
                                 "qid string, query string")


def rows(df):
    return sorted((r.qid, r.docno, round(r.score, 6), r["rank"]) for r in df.collect())



@pytest.mark.parametrize("make", [
    lambda i: Retriever(i, "BM25", 20), lambda i: Retriever(i, "DirichletLM", 20),
    lambda i: SequentialDependence() >> Retriever(i, "BM25", 20),
    lambda i: Retriever(i, "BM25", 3) >> Feedback(i, "RM3") >> Retriever(i, "BM25", 20),
    lambda i: Retriever(i, "BM25", 3) >> Feedback(i, "Bo1") >> Retriever(i, "PL2", 20)],
    ids=["bm25", "dirichlet", "sdm", "rm3", "bo1"])
def test_reopened_index_ranks_like_the_one_in_memory(memory, stored, topics, make):
    got = rows(make(stored)(topics))
    assert got and got == rows(make(memory)(topics))


def test_only_the_buckets_of_the_terms_are_read(spark, stored, topics):
    one = topics.filter("qid = '1'")
    wanted = {r.b for r in spark.createDataFrame([("waa",), ("common",)], "term string")
              .select(ix.bucket_of("term", 32).alias("b")).collect()}
    run = retrieve(stored, one, "BM25", 10)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    terms = spark.createDataFrame([("waa",), ("common",)], "term string")
    for name in ("postings", "lexicon", "positions"):
        read = stored.read(name, terms)
        scanned = read._jdf.queryExecution().executedPlan().toString()
        assert "bucket" in scanned.split("PartitionFilters")[1].split("]")[0]
        got = {r.b for r in read.select(ix.bucket_of("term", 32).alias("b")).distinct().collect()}
        assert got == wanted and len(got) < 3
    assert stored.read("postings", terms.limit(0)).count() == 0


def test_feedback_reads_the_direct_index(spark, stored, memory):
    run = spark.createDataFrame([("1", "d5", 2.0, 0), ("1", "d6", 1.0, 1), ("1", "d7", 0.5, 2), ("1", "d8", 0.1, 3)],
                                "qid string, docno string, score double, rank bigint")
    bags = _feedback_bags(stored, run, 3)
    assert bags.inputFiles() and all("/direct/" in f for f in bags.inputFiles())
    plan = bags._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "SortMergeJoin" not in plan
    key = lambda df: sorted((r.docno, r.term, r.tf, r.dl) for r in df.collect())
    assert key(bags) == key(_feedback_bags(memory, run, 3))
    assert {d for d, *_ in key(bags)} == {"d5", "d6", "d7"}


def test_crashed_builds_are_not_seen_and_forced_ones_replace(spark, corpus, tmp_path, monkeypatch):
    path = f"file:{tmp_path}/i"
    with pytest.raises(FileNotFoundError):
        Index.load(spark, path)
    first = Index.open_or_build(corpus.limit(10), path, STOP_ONLY, buckets=4)
    assert first.stats["num_docs"] == 10
    built = build_index(corpus, STOP_ONLY)
    with pytest.raises(FileExistsError):
        built.write(path, buckets=4)

    def crash(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(Index, "stats_frame", crash)      # after the postings are written, before the commit
        with pytest.raises(RuntimeError):
            Index.open_or_build(corpus, path, STOP_ONLY, force=True, buckets=4)
    again = Index.open_or_build(corpus, path, STOP_ONLY, buckets=4)
    assert again.stats["num_docs"] == 10 and again.identity == first.identity
    forced = Index.open_or_build(corpus, path, STOP_ONLY, force=True, buckets=8)
    assert forced.stats["num_docs"] == 122 and forced.buckets == 8
    assert first.postings.count() > 0               # who opened the earlier build still reads it
    assert Index.load(spark, path).identity == built.identity != first.identity


def test_positions_asked_for_later_build_again(spark, corpus, tmp_path):
    path = f"file:{tmp_path}/i"
    assert Index.open_or_build(corpus.limit(5), path, STOP_ONLY, buckets=4).positions is None
    assert Index.open_or_build(corpus.limit(5), path, STOP_ONLY, buckets=4, positions=True).positions.count() > 0
    assert len(list((tmp_path / "i" / "builds").iterdir())) == 2
    assert Index.open_or_build(corpus.limit(5), path, STOP_ONLY, buckets=4).positions is not None
    assert len(list((tmp_path / "i" / "builds").iterdir())) == 2


def test_an_empty_corpus_is_stored_and_searched(spark, corpus, topics, tmp_path):
    index = Index.open_or_build(corpus.limit(0), f"file:{tmp_path}/i", STOP_ONLY, positions=True, buckets=4)
    assert index.stats["num_docs"] == 0
    assert retrieve(index, topics, "BM25", 5).count() == 0
    assert index.read("direct", corpus).count() == 0
