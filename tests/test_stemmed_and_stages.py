"""Stemmed retrieval, proximity and spelling against plain Python; composed
stages; indexes reopened with their analyzer."""
from collections import Counter
from math import log

import pytest

import __spark_entry__ as E
from rankframe.functions.text import DEFAULT, RAW, STOP_ONLY
from rankframe.operators import rewrite as rw
from rankframe.operators.index import Index, build_index
from rankframe.plans.algebra import Retriever
from rankframe.plans.context import ctx

SF = "/root/testdata/sf0.001"
DOCS = [("d1", "hopping cats running quickly"), ("d2", "the cat runs"), ("d3", "dogs and dogs and dogs sleep"),
        ("d4", "run cat hop hop cat running cats"), ("d5", "")]
STEM = {"hopping": "hop", "cats": "cat", "running": "run", "runs": "run", "dogs": "dog", "quickly": "quickli"}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "docno string, text string")


def stems(text):
    return [STEM.get(w, w) for w in text.split() if w not in ("the", "and")]


def pair_counts():
    """(clause, docno) → hits of every ordered pair of neighbours and window pair."""
    out = Counter()
    for docno, text in DOCS:
        toks = stems(text)
        for i, a in enumerate(toks):
            for j, b in enumerate(toks):
                if j == i + 1:
                    out[f"#1({a} {b})", docno] += 1
                if i != j and abs(i - j) < 8:
                    out[f"#uw8({a} {b})", docno] += 1
    return out


@pytest.mark.parametrize("positions", [False, True])
def test_proximity_works_on_stems(spark, corpus, positions):
    index = build_index(corpus, DEFAULT, positions=positions)
    topics = spark.createDataFrame([("1", "hopping cats running"), ("2", "dogs dog sleeping")], "qid string, query string")
    clauses = rw.sdm_clauses(topics, DEFAULT)
    got = {(r.clause, r.docno): r.tf for r in rw.pair_postings(index, clauses.filter("kind <> 'u'")).collect()}
    wanted = {f"{kind}({pair})" for kind in ("#1", "#uw8") for pair in ("hop cat", "cat run", "dog dog", "dog sleep")}
    assert got == {k: n for k, n in pair_counts().items() if k[0] in wanted}


def test_known_surface_forms_are_not_corrected(spark, corpus):
    topics = spark.createDataFrame([("1", "cats runing " + "x" * 10_000)], "qid string, query string")
    row = rw.spell_correct(topics, build_index(corpus, DEFAULT)).first()
    assert row["query"] == "cats running " + "x" * 10_000


def test_composition_keeps_the_query(spark, corpus):
    index = build_index(corpus, STOP_ONLY)
    topics = spark.createDataFrame([("1", "cat running", "kept")], "qid string, query string, note string")
    bm = Retriever(index, "BM25")
    once, twice = bm(topics).collect(), (bm >> bm)(topics).collect()
    key = lambda rows: {(r.qid, r.docno, r.score, r["rank"], r["query"], r.note) for r in rows}
    assert key(once) == key(twice) and len(once) > 1
    assert {r.docno for r in (bm >> Retriever(index, "PL2") % 1)(topics).collect()} <= {r.docno for r in once}


def test_cutoff_reaches_the_retrieval(spark, corpus):
    cut = Retriever(build_index(corpus, STOP_ONLY), "BM25") % 1
    assert cut.k == 1
    topics = spark.createDataFrame([("1", "cat running")], "qid string, query string")
    assert cut(topics).count() == 1


def test_index_reopens_with_its_analyzer(spark, corpus, tmp_path, monkeypatch):
    path = f"file:{tmp_path}/index"
    first = Index.open_or_build(corpus, path, DEFAULT, positions=True)
    assert first.analyzer == DEFAULT and first.surface.count() > 0
    with pytest.raises(ValueError):
        Index.load(spark, path, RAW)
    monkeypatch.setattr("rankframe.operators.index.build_index", lambda *a, **k: pytest.fail("built again"))
    assert Index.open_or_build(corpus, path, DEFAULT).stats == first.stats


def test_stemmed_bm25_against_python(spark):
    """Every score of the stemmed key, from stems, counts and the BM25 formula
    (k1 1.2, b 0.75)."""
    c = ctx(spark, SF)
    idx = c.index(DEFAULT)
    stem = {r["term"]: r["stem"] for r in E.queries()["porter_stem"](spark, SF).collect()}
    toks = lambda df, key, text: {r[key]: r["t"] for r in df.select(key, DEFAULT.tokens(df[text]).alias("t")).collect()}
    docs = {d: Counter(stem[w] for w in t) for d, t in toks(c.corpus, "docno", "text").items()}
    df = Counter(t for bag in docs.values() for t in bag)
    lengths = {d: sum(bag.values()) for d, bag in docs.items()}
    assert idx.stats["num_tokens"] == sum(lengths.values()) and idx.stats["num_terms"] == len(df)
    n, avg = len(docs), sum(lengths.values()) / len(docs)
    queries = toks(c.topics, "qid", "query")
    vocab = DEFAULT.stem_frame(spark.createDataFrame([(w,) for t in queries.values() for w in t], "w string").distinct(), "w", "s")
    qstem = {r["w"]: r["s"] for r in vocab.collect()}
    got = E.queries()["bm25_porter"](spark, SF).collect()
    assert got
    for r in got:
        q, bag, dl = Counter(qstem[w] for w in queries[r.qid]), docs[r.docno], lengths[r.docno]
        want = sum(f * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * dl / avg))
                   * log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t, f in q.items() if t in bag)
        assert abs(r.score - want) < 2e-6
