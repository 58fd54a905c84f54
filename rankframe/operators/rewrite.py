"""Query rewriting and expansion as DataFrame jobs.

* ``apply_query``: Column-builder rewrite, the previous query pushed to
  ``query_0`` (earlier ones shift to ``query_1``…).
* SDM: unigram / ordered-pair / unordered-window clauses; pair
  "pseudo-postings" come from the next few wanted positions of each wanted
  position in its document — bounded fan-out (window width), never all pairs.
* Bo1 and RM3 pseudo-relevance feedback over the top feedback documents.
* Spelling: unknown query words ⋈ corpus lexicon through deletion-neighbourhood
  keys (equi-join), verified by Levenshtein distance.
* Generated-text handling (prompts, line cleaning, expansion, multi
  expansion, rewrite) over a *generations table* (qid, raw) — the model call
  itself is outside (see README); a user batch generator can fill that table
  with ``mapInPandas``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer, clean_generation, sanitize, split_lines
from ..session import bounded_broadcast
from .index import Index, term_positions
from .retrieve import QueryTerms, with_query_length

# --- fixed values -----------------------------------------------------------------
SDM_WEIGHTS = (0.85, 0.10, 0.05)     # unigram, ordered pair, unordered pair
SDM_WINDOW = 8                       # unordered window: |p2 - p1| < 8
BO1_FB_DOCS, BO1_FB_TERMS = 3, 10
RM3_FB_DOCS, RM3_FB_TERMS, RM3_LAMBDA = 3, 10, 0.6
SPELL_MAX_EDITS = 2
EXPANSION_SYSTEM_PROMPT = (
    "You are an expert Information Retrieval assistant. "
    "Your task is to generate alternative phrasings and synonyms for a search query "
    "as they would appear in relevant documents. "
    "Return ONLY the alternative phrasings, one per line, no numbering, "
    "no bullet points, no explanation."
)
EXPANSION_USER_TEMPLATE = (
    "Given the search query: %s\n\n"
    "Generate 5 alternative phrasings and synonyms that a relevant document might use.\n"
    "Return only the terms, one per line."
)
MULTI_SYSTEM_TEMPLATE = (
    "You are an expert Information Retrieval assistant. "
    "Generate exactly %d alternative search queries for the given "
    "query. Output only the queries, one per line, no numbering, "
    "no explanation."
)
MULTI_USER_TEMPLATE = "Original query: %s\n\nAlternative queries:"
REWRITE_SYSTEM_PROMPT = (
    "You are an expert Information Retrieval assistant. "
    "Given a search query and additional context, rewrite the query "
    "to better capture the information need. "
    "Return ONLY the rewritten query — no explanation, no quotes."
)
REWRITE_USER_TEMPLATE = "Context: %s\n\nOriginal query: %s\n\nRewritten query:"
# --- end of fixed values ------------------------------------------------------------


# ------------------------------------------------------------------ apply_query --

def apply_query(topics: DataFrame, fn) -> DataFrame:
    """Rewrite ``query`` with ``fn`` (Column → Column, or a pandas-Series
    function wrapped by the caller in ``pandas_udf``); earlier queries shift
    to ``query_0``, ``query_1``, …"""
    olds = sorted([c for c in topics.columns if c.startswith("query_")],
                  key=lambda c: int(c.split("_")[1]), reverse=True)
    for c in olds:
        topics = topics.withColumnRenamed(c, f"query_{int(c.split('_')[1]) + 1}")
    return topics.withColumn("query_0", F.col("query")).withColumn("query", fn(F.col("query")))


def sanitize_topics(topics: DataFrame) -> DataFrame:
    return topics.withColumn("query", sanitize(F.col("query")))


# ------------------------------------------------------------------------ SDM --

def sdm_clauses(topics: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(qid, kind, clause, a, b, weight): unigrams, ordered adjacent pairs and
    unordered pairs of the analysed (stemmed) query, with their SDM weights."""
    raw = topics.select(F.col("qid").cast("string").alias("qid"),
                        F.posexplode(analyzer.tokens(F.col("query"))).alias("pos", "raw"))
    t = (analyzer.stem_frame(raw, "raw", "term")
         .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("at"))
         .select("qid", F.col("at.term").alias("toks")))
    uni = t.select("qid", F.explode("toks").alias("a")).select(
        "qid", F.lit("u").alias("kind"), F.col("a").alias("clause"), "a",
        F.lit(None).cast("string").alias("b"))
    pairs = t.select("qid", F.explode(F.arrays_zip(
        F.slice("toks", 1, F.greatest(F.size("toks") - 1, F.lit(0))),
        F.slice("toks", 2, F.greatest(F.size("toks") - 1, F.lit(0))))).alias("p"))
    pairs = pairs.select("qid", F.col("p.0").alias("a"), F.col("p.1").alias("b"))
    od = pairs.select("qid", F.lit("o").alias("kind"),
                      F.concat(F.lit("#1("), "a", F.lit(" "), "b", F.lit(")")).alias("clause"),
                      "a", "b")
    uw = pairs.select("qid", F.lit("w").alias("kind"),
                      F.concat(F.lit(f"#uw{SDM_WINDOW}("), "a", F.lit(" "), "b", F.lit(")"))
                      .alias("clause"), "a", "b")
    w = {"u": SDM_WEIGHTS[0], "o": SDM_WEIGHTS[1], "w": SDM_WEIGHTS[2]}
    allc = uni.unionByName(od).unionByName(uw)
    return (allc.groupBy("qid", "kind", "clause", "a", "b").agg(F.count("*").alias("n"))
            .withColumn("weight", F.col("n").cast("double") * F.element_at(
                F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v))]),
                F.col("kind")))
            .drop("n"))


def pair_postings(index: Index, pairs: DataFrame) -> DataFrame:
    """(clause, docno, tf, dl) for the distinct pair clauses (kind o / w).

    The positions of the pair terms are filtered on the map side and shuffled
    once, by document. Fewer than SDM_WINDOW of them can follow a position
    inside the window, so the next SDM_WINDOW - 1 rows hold all its partners."""
    pairs = pairs.select("kind", "clause", "a", "b").distinct()
    terms = (pairs.select(F.col("a").alias("term")).union(pairs.select(F.col("b").alias("term")))
             .distinct())
    here = Window.partitionBy("docno").orderBy("p")
    near = term_positions(index, terms).select("docno", "dl", "term", "p", F.array(*[
        F.lead(F.struct("term", "p"), d).over(here) for d in range(1, SDM_WINDOW)]).alias("next"))
    near = near.select("docno", "dl", F.col("term").alias("t1"), "p", F.explode("next").alias("n"))
    near = near.select("docno", "dl", "t1", F.col("n.term").alias("t2"), (F.col("n.p") - F.col("p")).alias("gap"))
    both = (near.filter(F.col("gap") < SDM_WINDOW)
            .select("docno", "dl", F.explode(F.array(
                F.struct(F.col("t1").alias("a"), F.col("t2").alias("b"), (F.col("gap") == 1).alias("ordered")),
                F.struct(F.col("t2").alias("a"), F.col("t1").alias("b"), F.lit(False).alias("ordered"))))
                .alias("h")).select("docno", "dl", "h.*"))
    hits = both.join(bounded_broadcast(pairs), ["a", "b"]).filter(F.col("ordered") | (F.col("kind") == "w"))
    return hits.groupBy("clause", "docno", "dl").agg(F.count("*").cast("bigint").alias("tf"))


def sdm_query(index: Index, topics: DataFrame):
    """→ (postings', lexicon', QueryTerms) where unigram and pair clauses
    are terms of one weighted query."""
    cl = sdm_clauses(topics, index.analyzer).persist()
    pp = pair_postings(index, cl.filter(F.col("kind") != "u"))
    pp = pp.select(F.col("clause").alias("term"), "docno", "tf", "dl").persist()
    plex = pp.groupBy("term").agg(F.count("*").cast("bigint").alias("df"),
                                  F.sum("tf").cast("bigint").alias("cf"))
    words = cl.filter(F.col("kind") == "u").select(F.col("clause").alias("term"))
    postings = index.read("postings", words).select("term", "docno", "tf", "dl").unionByName(pp)
    lexicon = index.read("lexicon", words).unionByName(plex)
    qt = cl.select("qid", F.col("clause").alias("term"), F.col("weight").alias("qtf"))
    return postings, lexicon, QueryTerms(qt)


# ------------------------------------------------------------------- feedback --

def _feedback_bags(index: Index, run: DataFrame, fb_docs: int) -> DataFrame:
    """(qid, docno, score, term, tf, dl) for the fb_docs best documents of
    each query. The feedback set is small and broadcast: into the direct index
    of a stored index, of which only the buckets of these documents are read,
    else into the postings; neither is shuffled."""
    fb = run.filter(F.col("rank") < fb_docs).select("qid", "docno", "score").persist()
    return index.read("direct", fb).join(bounded_broadcast(fb), "docno")


def bo1_terms(index: Index, run: DataFrame, qterms: DataFrame,
              fb_docs: int = BO1_FB_DOCS, fb_terms: int = BO1_FB_TERMS) -> DataFrame:
    """Bo1 (Bose-Einstein) expansion → (qid, term, qtf) reweighted query:
    qtf/max qtf + w/max w over the original terms ∪ the fb_terms best terms."""
    N = float(index.stats["num_docs"])
    bags = _feedback_bags(index, run, fb_docs)
    tfx = bags.groupBy("qid", "term").agg(F.sum("tf").cast("double").alias("tfx")).persist()
    tfx = tfx.join(index.read("lexicon", tfx).select("term", "cf"), "term")
    P = F.col("cf").cast("double") / F.lit(N)
    w = F.col("tfx") * F.log2((F.lit(1.0) + P) / P) + F.log2(F.lit(1.0) + P)
    ranked = tfx.withColumn("w", w).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("w").desc(),
                                                                     F.col("term").asc())))
    top = ranked.filter(F.col("_rn") <= fb_terms).select("qid", "term", "w")
    orig = qterms.select("qid", "term", "qtf")
    merged = orig.join(top, ["qid", "term"], "full_outer")
    wq = Window.partitionBy("qid")
    out = merged.select(
        "qid", "term",
        (F.coalesce(F.col("qtf"), F.lit(0.0)) / F.max("qtf").over(wq)
         + F.coalesce(F.col("w") / F.max("w").over(wq), F.lit(0.0))).alias("qtf"))
    return out


def rm3_terms(index: Index, run: DataFrame, qterms: DataFrame,
              fb_docs: int = RM3_FB_DOCS, fb_terms: int = RM3_FB_TERMS,
              lam: float = RM3_LAMBDA) -> DataFrame:
    """RM3 → (qid, term, qtf): λ·qtf/Σqtf + (1-λ)·p_R(w), p_R over the
    fb_terms best terms renormalised; p_R(w) ∝ Σ_d tf/dl · score_d/Σscore."""
    bags = _feedback_bags(index, run, fb_docs)
    wq = Window.partitionBy("qid")
    docs = run.filter(F.col("rank") < fb_docs).select("qid", "docno", "score")
    docs = docs.withColumn("pq", F.col("score") / F.sum("score").over(wq))
    pr = (bags.join(bounded_broadcast(docs.select("qid", "docno", "pq")), ["qid", "docno"])
          .groupBy("qid", "term")
          # rounded so that float summation order cannot reorder near-ties
          .agg(F.round(F.sum(F.col("tf").cast("double") / F.col("dl") * F.col("pq")), 12)
               .alias("pr")))
    ranked = pr.withColumn("_rn", F.row_number().over(
        Window.partitionBy("qid").orderBy(F.col("pr").desc(), F.col("term").asc())))
    top = ranked.filter(F.col("_rn") <= fb_terms).select("qid", "term", "pr")
    top = top.withColumn("pr", F.col("pr") / F.sum("pr").over(wq))
    orig = qterms.select("qid", "term", "qtf")
    merged = orig.join(top, ["qid", "term"], "full_outer")
    return merged.select(
        "qid", "term",
        (F.lit(lam) * F.coalesce(F.col("qtf"), F.lit(0.0)) / F.sum("qtf").over(wq)
         + F.lit(1.0 - lam) * F.coalesce(F.col("pr"), F.lit(0.0))).alias("qtf"))


# ------------------------------------------------------------------- spelling --

def _deletions(word: Column, max_del: int = SPELL_MAX_EDITS) -> Column:
    """The word and every variant with 1..max_del characters deleted."""
    def del1(w):
        return F.transform(F.sequence(F.lit(1), F.length(w)),
                           lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    d1 = F.when(F.length(word) >= 1, del1(word)).otherwise(F.array().cast("array<string>"))
    keys = F.array_union(F.array(word), d1)
    if max_del >= 2:
        d2 = F.flatten(F.transform(d1, lambda v: F.when(F.length(v) >= 1, del1(v))
                                   .otherwise(F.array().cast("array<string>"))))
        keys = F.array_union(keys, d2)
    return keys


def spell_correct(topics: DataFrame, index: Index, known_extra: list[str] = (),
                  max_edits: int = SPELL_MAX_EDITS) -> DataFrame:
    """Correct each word (split on a single space) that is not a known surface
    form: best form within ``max_edits`` by (distance, -cf, form); unknown
    words without a candidate stay. Output (qid, query, query_0)."""
    words = topics.select(F.col("qid").cast("string").alias("qid"), "query",
                          F.posexplode(F.split(F.col("query"), " ")).alias("pos", "word"))
    lex = index.surface.select("term", "cf")
    known = lex.select(F.col("term").alias("word"))
    if known_extra:
        spark = topics.sparkSession
        known = known.unionByName(spark.createDataFrame([(w,) for w in known_extra], "word string"))
    unknown = (words.select("word").distinct().join(known, "word", "left_anti")
               # a longer word is more than max_edits from every indexed form
               .filter(F.length("word").between(1, index.analyzer.max_term_length + max_edits)))
    ukeys = unknown.select("word", F.explode(_deletions(F.col("word"), max_edits)).alias("key"))
    n_uk = ukeys.persist().count()
    lkeys = lex.select("term", "cf", F.explode(_deletions(F.col("term"), max_edits)).alias("key"))
    cand = (lkeys.join(bounded_broadcast(ukeys, known_rows=n_uk), "key")
            .select("word", "term", "cf").distinct()
            .withColumn("dist", F.levenshtein("word", "term"))
            .filter(F.col("dist") <= max_edits))
    best = (cand.withColumn("_rn", F.row_number().over(Window.partitionBy("word").orderBy(
        F.col("dist").asc(), F.col("cf").desc(), F.col("term").asc())))
        .filter("_rn = 1").select("word", F.col("term").alias("fix")))
    fixed = words.join(bounded_broadcast(best), "word", "left").withColumn(
        "w2", F.coalesce(F.col("fix"), F.col("word")))
    return (fixed.groupBy("qid", "query")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w2"))),
                                          lambda s: s["w2"]), " ").alias("corrected"))
            .select("qid", F.col("corrected").alias("query"), F.col("query").alias("query_0")))


# ------------------------------------------------------- generated expansions --

def build_prompts(topics: DataFrame, n_multi: int = 3,
                  context: Column | None = None) -> DataFrame:
    """(qid, system_prompt, user_prompt, multi_system, multi_user,
    rewrite_system, rewrite_user) for every topic."""
    ctx_col = F.coalesce(context, F.lit("")) if context is not None else F.lit("")
    return topics.select(
        "qid",
        F.lit(EXPANSION_SYSTEM_PROMPT).alias("system_prompt"),
        F.format_string(EXPANSION_USER_TEMPLATE, F.col("query")).alias("user_prompt"),
        F.lit(MULTI_SYSTEM_TEMPLATE % n_multi).alias("multi_system"),
        F.format_string(MULTI_USER_TEMPLATE, F.col("query")).alias("multi_user"),
        F.lit(REWRITE_SYSTEM_PROMPT).alias("rewrite_system"),
        F.format_string(REWRITE_USER_TEMPLATE, ctx_col, F.col("query")).alias("rewrite_user"))


def generation_lines(gen: DataFrame) -> DataFrame:
    """(qid, line_no, line, cleaned) for every line of every raw generation
    (the raw text is stripped first, as the model client does)."""
    stripped = F.regexp_replace(F.col("raw"), r"^\s+|\s+$", "")
    return gen.select("qid", F.posexplode(split_lines(stripped)).alias("line_no", "line")
                      ).withColumn("cleaned", clean_generation(F.col("line")))


def _phrases(raw: Column) -> Column:
    lines = split_lines(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.filter(F.transform(lines, clean_generation), lambda p: F.length(p) > 0)


def expand(topics_with_raw: DataFrame) -> DataFrame:
    """Expanded query: the query's and the phrases' whitespace tokens,
    lower-cased, first occurrence kept, in order; raw query when there is no
    generation or no non-empty phrase."""
    ph = _phrases(F.col("raw"))
    text = F.concat_ws(" ", F.col("query"), F.array_join(ph, " "))
    toks = F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > 0)
    bag = F.array_join(F.array_distinct(toks), " ")
    return topics_with_raw.select(
        "qid", F.col("query").alias("original_query"),
        F.when(F.col("raw").isNull() | (F.size(ph) == 0), F.col("query")).otherwise(bag)
        .alias("query"))


def expand_multi(topics_with_raw: DataFrame, n: int = 3, sep: str = " ") -> DataFrame:
    """Query + the first n cleaned non-empty lines, no dedup, case kept."""
    lines = split_lines(F.regexp_replace(F.col("raw"), r"^\s+|\s+$", ""))
    kept = F.filter(F.transform(F.filter(lines, lambda l: F.length(F.trim(l)) > 0),
                                clean_generation), lambda p: F.length(p) > 0)
    alts = F.slice(kept, 1, n)
    return topics_with_raw.select(
        "qid", F.when(F.col("raw").isNull() | (F.size(alts) == 0), F.col("query"))
        .otherwise(F.concat_ws(sep, F.col("query"), F.array_join(alts, sep))).alias("query"))


def rewrite(topics_with_raw: DataFrame) -> DataFrame:
    """Single cleaned rewrite of the whole generation, else the query."""
    cleaned = clean_generation(F.regexp_replace(F.col("raw"), r"^\s+|\s+$", ""))
    return topics_with_raw.select(
        "qid", F.coalesce(F.nullif(cleaned, F.lit("")), F.col("query")).alias("query"))
