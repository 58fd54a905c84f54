"""Registered queries, part 2: rewriting/expansion, algebra, experiments and
comparison tables, dense re-ranking, learning to rank, sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.text import STOP_ONLY, ENGLISH_STOPWORDS, sanitize
from ..operators import dense as dn
from ..operators import evaluate as ev
from ..operators import lambdamart, ltr
from ..operators import retrieve as rt
from ..operators import rewrite as rw
from ..operators.vectors import VectorStore
from ..session import ensure_checkpoint_dir
from ..sources import collection as col
from .algebra import DenseScore, Feedback, Interpolate, Retriever, SequentialDependence, Stage, cached
from .context import ctx
from .registry import DISPLAY_METRICS, EVAL_DEPTH, TOPK, _eval_run, _run, query, r6
from .tuning import grid_search

RUN_COLUMNS = ["qid", "docno", "score", "rank"]
SYSTEMS = ["BM25", "TF_IDF", "DirichletLM"]


def _conv(c):
    return c.memo("conv_topics", lambda: col.conversation_topics(c.spark, c.sf_dir).persist())


# ------------------------------------------------------------- rewriting --

@query("rewrite_prefix")
def q_rewrite_prefix(spark, d):
    c = ctx(spark, d)
    t = rw.apply_query(c.topics, sanitize)
    t = rw.apply_query(t, lambda q: col.misspell_expr(q))
    return t.select("qid", "query", "query_0", "query_1")


@query("sanitize_query")
def q_sanitize(spark, d):
    return _conv(ctx(spark, d)).select("qid", sanitize(F.col("query")).alias("query"))


@query("sdm_clauses")
def q_sdm_clauses(spark, d):
    c = ctx(spark, d)
    cl = rw.sdm_clauses(c.topics, c.index().analyzer)
    return cl.select("qid", "kind", "clause", r6(F.col("weight")).alias("weight"))


def _sdm_run(c, k):
    return (SequentialDependence() >> _stage(c, "BM25", k))(c.topics).select(*RUN_COLUMNS)


@query("sdm_bm25")
def q_sdm_bm25(spark, d):
    return _sdm_run(ctx(spark, d), TOPK)


def _fb_run(c):
    return c.memo("fb_run", lambda: _run(c, "BM25", 3).persist())


def _bo1(c):
    return c.memo("bo1", lambda: rw.bo1_terms(c.index(), _fb_run(c), c.qterms().df).persist())


def _rm3(c):
    return c.memo("rm3", lambda: rw.rm3_terms(c.index(), _fb_run(c), c.qterms().df).persist())


def _feedback(c, kind, index=None):
    index = index or c.index()
    return Retriever(index, "BM25", 3) >> Feedback(index, kind) >> Retriever(index, "BM25", TOPK)


@query("bo1_terms")
def q_bo1_terms(spark, d):
    return _bo1(ctx(spark, d)).select("qid", "term", r6(F.col("qtf")).alias("qtf"))


@query("bo1_bm25")
def q_bo1_bm25(spark, d):
    c = ctx(spark, d)
    return _feedback(c, "Bo1")(c.topics).select(*RUN_COLUMNS)


@query("rm3_terms")
def q_rm3_terms(spark, d):
    return _rm3(ctx(spark, d)).select("qid", "term", r6(F.col("qtf")).alias("qtf"))


@query("rm3_bm25")
def q_rm3_bm25(spark, d):
    c = ctx(spark, d)
    return _feedback(c, "RM3")(c.topics).select(*RUN_COLUMNS)


# retrieval, feedback and dependence over the index that is written, reopened and read by bucket

@query("stored_bm25")
def q_stored_bm25(spark, d):
    c = ctx(spark, d)
    return Retriever(c.stored_index(), "BM25", TOPK)(c.topics).select(*RUN_COLUMNS)


@query("stored_bo1")
def q_stored_bo1(spark, d):
    c = ctx(spark, d)
    return _feedback(c, "Bo1", c.stored_index())(c.topics).select(*RUN_COLUMNS)


@query("stored_rm3")
def q_stored_rm3(spark, d):
    c = ctx(spark, d)
    return _feedback(c, "RM3", c.stored_index())(c.topics).select(*RUN_COLUMNS)


@query("stored_sdm")
def q_stored_sdm(spark, d):
    c = ctx(spark, d)
    return (SequentialDependence() >> Retriever(c.stored_index(), "BM25", TOPK))(c.topics).select(*RUN_COLUMNS)


@query("spell_correct")
def q_spell(spark, d):
    c = ctx(spark, d)
    t = c.topics.select("qid", col.misspell_expr(sanitize(F.col("query"))).alias("query"))
    return rw.spell_correct(t, c.index(), known_extra=ENGLISH_STOPWORDS)


@query("build_prompts")
def q_prompts(spark, d):
    c = ctx(spark, d)
    t = _conv(c).join(col.conversation_context(spark, d), "conv_id", "left")
    return rw.build_prompts(t, 3, F.col("context"))


@query("clean_generation")
def q_clean(spark, d):
    g = _conv(ctx(spark, d)).filter(F.col("raw").isNotNull())
    return rw.generation_lines(g).select("qid", F.col("line_no").cast("bigint").alias("line_no"),
                                         "cleaned")


@query("llm_expand")
def q_llm_expand(spark, d):
    return rw.expand(_conv(ctx(spark, d)))


@query("llm_expand_multi")
def q_llm_multi(spark, d):
    return rw.expand_multi(_conv(ctx(spark, d)), 3)


@query("llm_rewrite")
def q_llm_rewrite(spark, d):
    return rw.rewrite(_conv(ctx(spark, d)))


@query("llm_qe_bm25")
def q_llm_qe(spark, d):
    c = ctx(spark, d)
    t = rw.expand(_conv(c)).select("qid", sanitize(F.col("query")).alias("query"))
    return rt.retrieve(c.index(), t, "BM25", TOPK)


@query("rewrite_eval")
def q_rewrite_eval(spark, d):
    c = ctx(spark, d)
    base = _eval_run(c)
    rewritten = rt.retrieve(c.index(), rw.sanitize_topics(c.topics), "BM25", EVAL_DEPTH)
    m = ev.experiment({"original": base, "rewritten": rewritten}, c.qrels, ["AP(rel=3)"],
                      missing="drop")
    return m.select("system", r6(F.col("value")).alias("value"))


# --------------------------------------------------------------- algebra --

def _stage(c, model, k):
    return Retriever(c.index(), model, k, c.sf_dir)


@query("rank_cutoff")
def q_rank_cutoff(spark, d):
    c = ctx(spark, d)
    return (_stage(c, "BM25", 100) % 5)(c.topics).select(*RUN_COLUMNS)


@query("rerank_pipeline")
def q_rerank_pipeline(spark, d):
    """Composition: the 100 best by BM25, scored anew by PL2, the best kept."""
    c = ctx(spark, d)
    pipe = _stage(c, "BM25", 100) >> _stage(c, "PL2", 100) % 20
    return pipe(c.topics).select("qid", "docno", "score_0", "score", "rank")


@query("linear_combine")
def q_linear_combine(spark, d):
    c = ctx(spark, d)
    pipe = 2 * _stage(c, "TF_IDF", 100) + _stage(c, "BM25", 100)
    return pipe(c.topics).select(*RUN_COLUMNS)


@query("feature_union")
def q_feature_union(spark, d):
    c = ctx(spark, d)
    idx = c.index()
    bm = _stage(c, "BM25", TOPK)
    pl2 = bm >> Retriever(idx, "PL2", TOPK, c.sf_dir)
    dph = bm >> Retriever(idx, "DPH", TOPK, c.sf_dir)
    out = (bm ** pl2 ** dph)(c.topics)
    return out.select("qid", "docno", "score", "rank", *[F.col("features")[i].alias(f"f{i}")
                                                          for i in range(3)])


@query("cached_retrieve")
def q_cached(spark, d):
    c = ctx(spark, d)
    path = os.path.join(ensure_checkpoint_dir(spark), f"rankframe-cache-{uuid.uuid4().hex}")
    st = cached(_stage(c, "BM25", TOPK), path)
    st(c.topics.filter(col.split_bucket("qid") <= 5))   # warm part of the cache
    return st(c.topics).select(*RUN_COLUMNS)             # hits + computed misses


# ----------------------------------------------------------- experiments --

def _runs(c):
    return {s: c.memo(f"eval_run_{s}", lambda s=s: _run(c, s, EVAL_DEPTH).persist())
            for s in SYSTEMS}


def _exp_long(c, per_query=False):
    key = "exp_pq" if per_query else "exp"
    return c.memo(key, lambda: ev.experiment(_runs(c), c.qrels, DISPLAY_METRICS, c.topics,
                                             missing="zero", per_query_out=per_query).persist())


@query("experiment")
def q_experiment(spark, d):
    return _exp_long(ctx(spark, d)).select("system", "metric", r6(F.col("value")).alias("value"))


def _ttest(c):
    pq = _exp_long(c, per_query=True)
    return ev.paired_ttest(pq, "BM25")


@query("paired_ttest")
def q_ttest(spark, d):
    t = _ttest(ctx(spark, d))
    return t.select("system", "metric", F.col("n").cast("bigint").alias("n"),
                    r6(F.col("mean_diff")).alias("mean_diff"), r6(F.col("t")).alias("t"),
                    r6(F.col("p")).alias("p"))


@query("bonferroni")
def q_bonferroni(spark, d):
    t = _ttest(ctx(spark, d))
    m = len(SYSTEMS) - 1
    return t.select("system", "metric", r6(ev.bonferroni(F.col("p"), m)).alias("p_adj"),
                    F.coalesce(F.col("p") * m < 0.05, F.lit(False)).alias("reject"))


@query("compare_methods")
def q_compare(spark, d):
    t = ev.compare_table(_exp_long(ctx(spark, d)), SYSTEMS)
    return t.select("metric", *[r6(F.col(s)).alias(s) for s in SYSTEMS])


@query("improvement_pct")
def q_improvement(spark, d):
    e = _exp_long(ctx(spark, d))
    base = e.filter(F.col("system") == "BM25").select("metric", F.col("value").alias("b"))
    return (e.filter(F.col("system") != "BM25").join(base, "metric")
            .select("metric", "system", ev.improvement_pct(F.col("value"), F.col("b")).alias("pct")))


@query("best_method")
def q_best(spark, d):
    b = ev.best_method(_exp_long(ctx(spark, d)), SYSTEMS)
    return b.select("metric", "best_system", r6(F.col("value")).alias("value"))


@query("compare_with_stub")
def q_stub(spark, d):
    """Systems expected by the comparison; one has no metrics (its step
    failed) and gets a zero stub with status 'stub'."""
    c = ctx(spark, d)
    e = _exp_long(c)
    expected = spark.createDataFrame([(s,) for s in SYSTEMS + ["failed_system"]], "system string")
    grid = expected.select("system", F.explode(F.array(*[F.lit(m) for m in DISPLAY_METRICS]))
                           .alias("metric"))
    out = grid.join(e, ["system", "metric"], "left")
    return out.select("system", "metric", r6(F.coalesce(F.col("value"), F.lit(0.0))).alias("value"),
                      F.when(F.col("value").isNull(), "stub").otherwise("ok").alias("status"))


@query("csv_metrics_roundtrip")
def q_csv_roundtrip(spark, d):
    from ..sinks import read_metrics_csv, write_metrics_csv
    c = ctx(spark, d)
    m = ev.evaluate_run(_eval_run(c), c.qrels, DISPLAY_METRICS)
    path = os.path.join(ensure_checkpoint_dir(spark), f"metrics-{uuid.uuid4().hex}")
    write_metrics_csv(m, DISPLAY_METRICS, path)
    back = read_metrics_csv(spark, path, DISPLAY_METRICS)
    return back.select("metric", r6(F.col("value")).alias("value"))


@query("trec_run_lines")
def q_trec(spark, d):
    from ..sinks import trec_lines
    return trec_lines(_run(ctx(spark, d), "BM25", TOPK), "bm25")


# ----------------------------------------------------------------- dense --

ENCODER = "hashed terms"
HYBRID_DEPTH = 1000   # candidates of the hybrid ranking


def _encode_topics(c):
    analyzer = c.index().analyzer
    return lambda topics: dn.encode(topics, "qid", "query", analyzer)


def _vectors(c):
    """(id, vector) of the topics and (docno, vector) of the documents."""
    def build():
        docs = dn.encode(c.corpus, "docno", "text", c.index().analyzer).withColumnRenamed("id", "docno")
        return _encode_topics(c)(c.topics).persist(), docs.persist()
    if "_vec" not in c._memo:
        c._memo["_vec"] = build()
    return c._memo["_vec"]


def _store(c):
    """The document vectors, written once and reopened."""
    def build():
        path = os.path.join(ensure_checkpoint_dir(c.spark), f"vectors-{uuid.uuid4().hex}")
        return VectorStore.open_or_encode(c.spark, path, lambda: _vectors(c)[1], ENCODER)
    if "_store" not in c._memo:
        c._memo["_store"] = build()
    return c._memo["_store"]


@query("hash_encode")
def q_hash_encode(spark, d):
    c = ctx(spark, d)
    s = dn.hash_sparse(c.topics, "qid", "query", c.index().analyzer)
    return s.select(F.col("id").alias("qid"), F.col("dim").cast("bigint").alias("dim"),
                    r6(F.col("value")).alias("value"))


def _dense_run(c, k=100):
    q, dvec = _vectors(c)
    return c.memo(f"dense_{k}", lambda: dn.dense_score(_run(c, "BM25", k), q, dvec).persist())


@query("dense_rerank")
def q_dense(spark, d):
    return _dense_run(ctx(spark, d))


@query("dense_reopen")
def q_dense_reopen(spark, d):
    """The same re-ranking by stored vectors, of the candidates' buckets alone."""
    c = ctx(spark, d)
    return _store(c).scores(_run(c, "BM25", 100), _vectors(c)[0])


@query("dense_best")
def q_dense_best(spark, d):
    """The 10 best of 100 candidates: codes first, whole vectors of those that can win."""
    c = ctx(spark, d)
    return _store(c).best(_run(c, "BM25", 100), _vectors(c)[0], TOPK)


@query("dense_maxp")
def q_maxp(spark, d):
    c = ctx(spark, d)
    run = _run(c, "BM25", 100)
    return dn.dense_score(run, _vectors(c)[0], dn.encode_passages(c.corpus, run, c.index().analyzer))


@query("interpolate")
def q_interpolate(spark, d):
    return dn.interpolate(_dense_run(ctx(spark, d)), 0.3)


def _hybrid(c, k=100):
    return Retriever(c.index(), "BM25", k) >> DenseScore(_vectors(c)[1], _encode_topics(c), ENCODER) >> Interpolate()


def _dev(c):
    dev = col.topic_split(c.topics).filter(F.col("split") == "dev").select("qid")
    return c.topics.join(dev, "qid", "left_semi")


@query("grid_search_alpha")
def q_grid(spark, d):
    c = ctx(spark, d)
    found = grid_search(_hybrid(c), {"interpolate__alpha": dn.ALPHA_GRID}, _dev(c), c.qrels, missing="drop")
    return found.table.select(F.col("interpolate__alpha").alias("alpha"), r6(F.col("value")).alias("map"), "best")


@query("grid_search")
def q_grid_two(spark, d):
    """Candidates and alpha together, judged topics without results at 0."""
    c = ctx(spark, d)
    found = grid_search(_hybrid(c), {"BM25__k": [5, 100], "interpolate__alpha": [0.1, 0.5, 0.9]}, _dev(c), c.qrels)
    return found.table.select(F.col("BM25__k").cast("bigint").alias("k"), F.col("interpolate__alpha").alias("alpha"),
                              r6(F.col("value")).alias("map"), "best")


@query("hybrid_rank")
def q_hybrid(spark, d):
    return rt.rank_within(dn.interpolate(_dense_run(ctx(spark, d), HYBRID_DEPTH), 0.3).drop("rank"), TOPK)


# ------------------------------------------------------------------- LTR --

def _cands(c):
    return c.memo("ltr_cands", lambda: _run(c, "BM25", 100).persist())


def _ltr_features(c):
    def build():
        idx = c.index()
        cand = _cands(c)
        jf = ltr.jaccard_features(cand, c.topics, ltr.doc_fields(c.corpus))
        # model features only for the candidates (restricted before aggregation)
        sm = rt.score_matches(idx, c.qterms(), ("PL2", "DPH", "BM25"), candidates=cand)
        f = sm.select("qid", "docno", F.array(*[r6(F.col(m)) for m in ("PL2", "DPH", "BM25")])
                      .alias("mf"))
        nch = c.corpus.select("docno", F.col("n_chars").cast("double").alias("n_chars"))
        out = (cand.join(jf, ["qid", "docno"], "left").join(f, ["qid", "docno"], "left")
               .join(nch, ["docno"], "left"))
        feats = F.array(F.coalesce("j_title", F.lit(0.0)), F.coalesce("j_abstract", F.lit(0.0)),
                        F.col("mf")[0], F.col("mf")[1], F.col("mf")[2],
                        F.coalesce("n_chars", F.lit(0.0)))
        return out.select("qid", "docno", "score", "rank", feats.alias("features")).persist()
    return c.memo("ltr_feats", build)


def _fcols(df, n=6, src="features"):
    return [r6(F.col(src)[i]).alias(f"f{i}") for i in range(n)]


@query("jaccard_features")
def q_jaccard(spark, d):
    c = ctx(spark, d)
    j = ltr.jaccard_features(_run(c, "BM25", TOPK), c.topics, ltr.doc_fields(c.corpus))
    return j.select("qid", "docno", r6(F.col("j_title")).alias("j_title"),
                    r6(F.col("j_abstract")).alias("j_abstract"))


@query("scalar_features")
def q_scalar(spark, d):
    c = ctx(spark, d)
    r = _run(c, "BM25", TOPK).join(c.corpus.select("docno", "n_chars"), "docno", "left")
    return r.select("qid", "docno", F.col("score").alias("f_score"),
                    F.col("n_chars").cast("double").alias("f_len"))


@query("ltr_features")
def q_ltr_features(spark, d):
    f = _ltr_features(ctx(spark, d))
    return f.select("qid", "docno", "score", "rank", *_fcols(f))


@query("single_topic_features")
def q_single(spark, d):
    c = ctx(spark, d)
    f = _ltr_features(c)
    first = c.topics.agg(F.min("qid").alias("qid"))
    return f.join(first, "qid", "left_semi").select("qid", "docno", "score", "rank", *_fcols(f))


@query("ltr_training_set")
def q_training(spark, d):
    c = ctx(spark, d)
    f = _ltr_features(c)
    train = col.topic_split(c.topics).filter(F.col("split") == "train").select("qid")
    t = ltr.training_set(f.join(train, "qid", "left_semi"), c.qrels)
    return t.select("qid", "docno", "label", *_fcols(t))


@query("ablate_features")
def q_ablate(spark, d):
    f = _ltr_features(ctx(spark, d))
    a = f.select("qid", "docno", ltr.remove_features(F.col("features"), [0]).alias("fa"))
    return a.select("qid", "docno", *_fcols(a, 5, "fa"))


@query("keep_features")
def q_keep(spark, d):
    f = _ltr_features(ctx(spark, d))
    a = f.select("qid", "docno", ltr.keep_features(F.col("features"), [1, 3]).alias("fk"))
    return a.select("qid", "docno", *_fcols(a, 2, "fk"))


def _split_feats(c, split):
    f = _ltr_features(c)
    ids = col.topic_split(c.topics).filter(F.col("split") == split).select("qid")
    return f.join(ids, "qid", "left_semi")


@query("ltr_pointwise")
def q_pointwise(spark, d):
    c = ctx(spark, d)
    model = ltr.fit_pointwise(ltr.training_set(_split_feats(c, "train"), c.qrels))
    return ltr.apply_model(model, _split_feats(c, "test"))


@query("ltr_lambdamart")
def q_lambdamart(spark, d):
    """Boosted trees on lambda gradients, stopped on the dev topics."""
    c = ctx(spark, d)
    train, dev = (ltr.training_set(_split_feats(c, s), c.qrels) for s in ("train", "dev"))
    return lambdamart.apply_lambdamart(lambdamart.fit_lambdamart(train, dev), _split_feats(c, "test"))


@query("ltr_ablation")
def q_ablation(spark, d):
    """One pointwise model per removed feature; all test runs evaluated in
    one experiment job."""
    c = ctx(spark, d)
    train = ltr.training_set(_split_feats(c, "train"), c.qrels).persist()
    test = _split_feats(c, "test")
    runs = {}
    for i in range(-1, 6):
        drop = [] if i < 0 else [i]
        tr = train.withColumn("features", ltr.remove_features(F.col("features"), drop))
        te = test.withColumn("features", ltr.remove_features(F.col("features"), drop))
        runs["all" if i < 0 else f"-f{i}"] = ltr.apply_model(ltr.fit_pointwise(tr), te)
    e = ev.experiment(runs, c.qrels, ["map"], missing="drop")
    return e.select(F.col("system").alias("removed"), r6(F.col("value")).alias("map"))


@query("inline_topics")
def q_inline(spark, d):
    """Literal query rows (as a user would type them) searched over the
    whole index."""
    c = ctx(spark, d)
    t = spark.createDataFrame([("q1", "information retrieval"), ("q2", "the thesher"),
                               ("q3", "ciónue de las")], "qid string, query string")
    return rt.retrieve(c.index(), t, "BM25", TOPK)
