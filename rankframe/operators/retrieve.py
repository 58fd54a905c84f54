"""Ranked retrieval: query terms ⋈ lexicon ⋈ postings → per-(query, doc) sum →
per-query top-k.

The k best of a batch (``best_matches``): the query vocabulary is broadcast into
the postings scan, ``scoring`` adds a document's matched postings up for all
queries inside the task where they follow each other (so they do in an index in
memory; others are dealt and sorted by document) and lets only k rows a query out. Those are rounded and
ranked, behind a map-side ``WindowGroupLimit``. Without a cutoff, or for given
candidates, ``score_matches`` gives one row per (query, document).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from ..functions.weighting import dirichlet_doc, model_fn
from ..session import BROADCAST_MAX_ROWS, bounded_broadcast, ensure_checkpoint_dir
from . import scoring
from .index import Index



def query_terms(topics: DataFrame, analyzer: Analyzer, query_col: str = "query") -> DataFrame:
    """(qid, term, qtf double, qlen double): analysed query-term counts and the
    query length Σqtf."""
    toks = topics.select(F.col("qid").cast("string").alias("qid"),
                         F.explode(analyzer.tokens(F.col(query_col))).alias("raw"))
    toks = analyzer.stem_frame(toks, "raw", "term").drop("raw")
    qt = toks.groupBy("qid", "term").agg(F.count("*").cast("double").alias("qtf"))
    return with_query_length(qt)


def with_query_length(qt: DataFrame) -> DataFrame:
    """Add qlen = Σ qtf per qid (window over a small, bounded table)."""
    return qt.withColumn("qlen", F.sum("qtf").over(Window.partitionBy("qid")))


class QueryTerms:
    """A query-term table with its proven size, persisted because it is
    reused by the lexicon join, the postings join and the size check."""

    def __init__(self, qt: DataFrame, max_rows: int = BROADCAST_MAX_ROWS):
        if "qlen" not in qt.columns:
            qt = with_query_length(qt)
        self.df = qt.persist()
        self.rows = self.df.count()
        self.small = self.rows <= max_rows
        self._lexicons: dict[int, tuple[Index, DataFrame]] = {}   # keeps the index, so that its id stays taken

    def lexicon(self, index: Index) -> DataFrame:
        """The terms' rows of the index's lexicon, counted once for all models."""
        if id(index) not in self._lexicons:
            found = index.read("lexicon", self.df)
            self._lexicons[id(index)] = index, found if index.stored else found.persist()
        return self._lexicons[id(index)][1]

    def side(self) -> DataFrame:
        return bounded_broadcast(self.df, known_rows=self.rows)


def _as_qt(q) -> QueryTerms:
    return q if isinstance(q, QueryTerms) else QueryTerms(q)


def matched_postings(postings: DataFrame, lexicon: DataFrame, q) -> DataFrame:
    """(qid, term, qtf, qlen, df, cf, docno, tf, dl) for every posting of a
    query term."""
    q = _as_qt(q)
    qlex = lexicon.join(q.side(), "term")
    qlex = bounded_broadcast(qlex, known_rows=q.rows) if q.small else qlex
    return postings.join(qlex, "term")


def score_matches(index: Index, q, models=("BM25",), postings: DataFrame | None = None,
                  lexicon: DataFrame | None = None, stats: dict | None = None,
                  candidates: DataFrame | None = None) -> DataFrame:
    """(qid, docno, dl, <model>...) un-ranked, un-rounded sums per model.

    ``candidates`` (qid, docno) restricts the matches before aggregation."""
    stats = stats or index.stats
    q = _as_qt(q)
    postings = postings if postings is not None else index.read("postings", q.df)
    if candidates is not None:
        # other documents' postings go before they meet the queries
        postings = postings.join(bounded_broadcast(candidates.select("docno").distinct()), "docno", "left_semi")
    m = matched_postings(postings, lexicon if lexicon is not None else q.lexicon(index), q)
    if candidates is not None:
        m = m.join(bounded_broadcast(candidates.select("qid", "docno")), ["qid", "docno"])
    aggs = [F.sum(model_fn(name)(F.col("tf"), F.col("dl"), F.col("df"), F.col("cf"),
                                 F.col("qtf"), stats)).alias(name) for name in models]
    out = m.groupBy("qid", "docno", "dl", "qlen").agg(*aggs)
    if "DirichletLM" in models:
        out = out.withColumn("DirichletLM",
                             F.col("DirichletLM") + dirichlet_doc(F.col("qlen"), F.col("dl")))
    return out.drop("qlen")


def best_matches(index: Index, q, models=("BM25",), k: int = 1000, postings: DataFrame | None = None,
                 lexicon: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    """The rows of ``score_matches`` that can be among a query's k best by the
    first model, its score rounded to 6 places; ties of the k-th included.

    Query terms go in blocks of bounded size, some blocks to a pass; the results of
    several blocks are written below the shared folder, k rows a query."""
    q = _as_qt(q)
    dealt = index.by_document and postings is None
    postings = postings if postings is not None else index.read("postings", q.df)
    lexicon = lexicon if lexicon is not None else q.lexicon(index)
    stats = stats or index.stats
    blocks = math.ceil(q.rows / scoring.BLOCK_ROWS)
    if blocks == 0:
        return score_matches(index, q, models, postings, lexicon, stats)
    if blocks == 1:
        return _best_of_blocks(postings, lexicon, *next(scoring.passes([q.df])), list(models), k, stats, dealt)
    path = f"{ensure_checkpoint_dir(postings.sparkSession).rstrip('/')}/rankframe-best-{uuid.uuid4().hex}"
    parts = (q.df.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) for b in range(blocks))
    for some, vocabulary in scoring.passes(parts):
        best = _best_of_blocks(postings, lexicon, some, vocabulary, list(models), k, stats, dealt)
        best = rank_within(best.withColumn("_s", F.round(models[0], 6)), k, "_s").drop("rank", "_s")
        best.write.mode("append").parquet(path)
    return postings.sparkSession.read.schema(best.schema).parquet(path)


def _best_of_blocks(postings: DataFrame, lexicon: DataFrame, blocks: list[scoring.Block], vocabulary, models: list[str],
                    k: int, stats: dict, dealt: bool) -> DataFrame:
    """``dealt``: a document's postings follow each other in one partition."""
    terms = F.broadcast(postings.sparkSession.createDataFrame(vocabulary))
    qlex = F.broadcast(lexicon.join(terms, "term"))  # no longer than the block
    one = F.lit(1.0)  # every model is linear in the query's term weight
    weights = [model_fn(name)(F.col("tf"), F.col("dl"), F.col("df"), F.col("cf"), one, stats).alias(f"w{i}")
               for i, name in enumerate(models)]
    matched = postings.join(qlex, "term")
    if not dealt:
        matched = (matched.select("docno", "dl", "tid", "tf", "df", "cf")
                   .repartition("docno").sortWithinPartitions("docno", "dl"))
    with_base = [m == "DirichletLM" for m in models]
    base = [dirichlet_doc(one, F.col("dl")).alias("base")] if any(with_base) else []
    return scoring.best_of_documents(matched.select("docno", "dl", *base, "tid", *weights), blocks, models, with_base, k)


def rank_within(df: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    """Per-qid order by (score desc, docno asc); keep k best; 0-based bigint
    rank. The filter is on ``row_number() <= k`` so Catalyst plans a
    WindowGroupLimit."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col("docno").asc())
    df = df.withColumn("_rn", F.row_number().over(w))
    if k is not None:
        df = df.filter(F.col("_rn") <= k)
    return df.withColumn("rank", (F.col("_rn") - 1).cast("bigint")).drop("_rn")


def retrieve(index: Index, topics: DataFrame | None = None, model: str = "BM25",
             k: int | None = 1000, qterms=None) -> DataFrame:
    """Batch retrieval → run ``(qid, docno, score, rank)``; scores rounded to 6
    places so ties (and therefore ranks) are deterministic."""
    q = qterms if qterms is not None else query_terms(topics, index.analyzer)
    s = score_matches(index, q, (model,)) if k is None else best_matches(index, q, (model,), k)
    run = rank_within(s.select("qid", "docno", F.round(F.col(model), 6).alias("score")), k)
    # k rows a query, which later stages read several times
    return run if k is None else run.persist()


def weighted_retrieve(index: Index, weighted: DataFrame, model: str = "BM25",
                      k: int | None = 1000) -> DataFrame:
    """Retrieval for a weighted term query ``(qid, term, qtf)`` (expanded
    queries: Bo1, RM3, generated phrasings)."""
    return retrieve(index, model=model, k=k, qterms=weighted)


def rescore_models(index: Index, run: DataFrame, models: list[str], topics: DataFrame | None = None) -> DataFrame:
    """(qid, docno, score_0, <model>...): the run's own documents scored by
    every model in one pass over the postings; a candidate matching no query
    term scores 0. Without ``topics`` the run holds its queries."""
    topics = run.select("qid", "query").distinct() if topics is None else topics
    cand = run.select(F.col("qid").cast("string").alias("qid"), "docno", F.col("score").alias("score_0"))
    s = score_matches(index, query_terms(topics, index.analyzer), models, candidates=cand)
    names = {m: f"_s{i}" for i, m in enumerate(models)}
    s = s.select("qid", "docno", *[F.col(m).alias(n) for m, n in names.items()])
    return (cand.join(s, ["qid", "docno"], "left")
            .select("qid", "docno", "score_0",
                    *[F.round(F.coalesce(F.col(n), F.lit(0.0)), 6).alias(m) for m, n in names.items()]))


def rescore(index: Index, run: DataFrame, topics: DataFrame, model: str = "BM25") -> DataFrame:
    """Score the given (qid, docno) candidates only; a candidate matching no
    query term scores 0. Previous score kept as ``score_0``; re-ranked."""
    return rank_within(rescore_models(index, run, [model], topics).withColumnRenamed(model, "score"))


def features_retrieve(index: Index, topics: DataFrame, model: str = "BM25",
                      features=("BM25", "PL2", "DPH"), k: int = 1000) -> DataFrame:
    """All models in one pass over the matched postings: rank by ``model``,
    ``features`` = array of the feature models' scores (rounded)."""
    models = list(dict.fromkeys([model, *features]))
    s = best_matches(index, query_terms(topics, index.analyzer), models, k)
    s = s.select("qid", "docno", F.round(F.col(model), 6).alias("score"),
                 F.array(*[F.round(F.col(m), 6) for m in features]).alias("features"))
    return rank_within(s, k)


def search(index: Index, query: str, model: str = "BM25", k: int = 1000,
           qid: str = "1") -> DataFrame:
    """One ad-hoc query string → run (same plan as batch retrieval)."""
    spark = index.postings.sparkSession
    topics = spark.createDataFrame([(qid, query)], "qid string, query string")
    return retrieve(index, topics, model, k)


def attach_meta(run: DataFrame, corpus: DataFrame, columns: list[str]) -> DataFrame:
    """Left join stored document columns onto a run (run rows are kept)."""
    meta = corpus.select("docno", *columns)
    return run.join(meta, "docno", "left")
