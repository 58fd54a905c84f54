"""Oracle SQL per registered key (DuckDB dialect, driver tables as views)."""

from __future__ import annotations

from .oracle import (D, QRELS, TOPICS, TOK, index_ctes, model_sql, per_query_ctes, r6,
                     run_ctes, toks)

ORACLE: dict[str, str] = {}

DISPLAY = ["map", "ndcg", "ndcg_cut_10", "P_5", "P_10", "recall_10", "recall_100"]


def sql(name):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


# ---------------------------------------------------------------- sources --
ORACLE["topics"] = "SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark"
ORACLE["qrels"] = "WITH " + QRELS + " SELECT qid, docno, label FROM qrels"
ORACLE["corpus_head"] = ("SELECT CAST(doc_id AS VARCHAR) AS docno, text FROM documents "
                         "ORDER BY CAST(doc_id AS VARCHAR) LIMIT 1")
ORACLE["collection_profile"] = "WITH " + QRELS + f""",
a AS (SELECT COUNT(*) AS n_queries FROM benchmark),
b AS (SELECT COUNT(*) AS n_qrels FROM qrels),
c AS (SELECT COUNT(*) AS n_docs FROM documents)
SELECT CAST(n_queries AS BIGINT) AS n_queries, CAST(n_qrels AS BIGINT) AS n_qrels,
       round(CAST(n_qrels AS DOUBLE) / n_queries, 6) AS judgments_per_query,
       CAST(n_docs AS BIGINT) AS n_docs FROM a, b, c"""
ORACLE["topic_split"] = """
SELECT qid, bucket, CASE WHEN bucket <= 5 THEN 'train' WHEN bucket <= 7 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT CAST(item_id AS VARCHAR) AS qid,
             CAST(CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 4)) AS BIGINT) % 10 AS INTEGER) AS bucket
      FROM benchmark)"""
ORACLE["regex_split_docs"] = r"""
SELECT 'D' || CAST(page_id AS VARCHAR) || '_' || CAST(pos - 1 AS VARCHAR) AS docno,
       CAST(page_id AS VARCHAR) AS page_id, CAST(pos - 1 AS BIGINT) AS pos,
       trim(regexp_replace(block, '<[^>]*>', '', 'g')) AS text
FROM (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS b FROM pages))"""

# ---------------------------------------------------------- text analysis --
ORACLE["tokenize"] = f"""
SELECT token, COUNT(*) AS n FROM (SELECT unnest({TOK.format(x='text')}) AS token FROM documents)
GROUP BY token"""
ORACLE["stopword_filter"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS docno, CAST(len({TOK.format(x='text')}) AS BIGINT) AS n_tokens,
       CAST(len({toks('text')}) AS BIGINT) AS n_kept FROM documents"""
ORACLE["postings"] = "WITH " + index_ctes() + " SELECT term, docno, tf FROM post"
ORACLE["lexicon"] = "WITH " + index_ctes() + " SELECT term, df, cf FROM lex"
ORACLE["doc_lengths"] = "WITH " + index_ctes() + " SELECT docno, dl FROM dl"
ORACLE["collection_stats"] = "WITH " + index_ctes() + """
SELECT CAST(n AS BIGINT) AS num_docs, CAST(c AS BIGINT) AS num_tokens,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM lex) AS num_terms,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM post) AS num_postings,
       round(avgdl, 6) AS avg_dl FROM stats"""
ORACLE["doc_term_bags"] = "WITH " + index_ctes() + """
SELECT docno, CAST(COUNT(*) AS BIGINT) AS n_terms,
       string_agg(term || ':' || CAST(tf AS VARCHAR), ' ' ORDER BY term) AS bag
FROM post GROUP BY docno"""
ORACLE["positions"] = "WITH " + index_ctes() + """,
pos AS (SELECT docno, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS p FROM dtoks)
SELECT term, docno, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions
FROM pos GROUP BY term, docno"""
ORACLE["fielded_postings"] = f"""
WITH w AS (SELECT CAST(page_id AS VARCHAR) AS docno,
                  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
                  trim(regexp_replace(array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), ' '),
                    '<[^>]*>', ' ', 'g')) AS abstract, url
           FROM pages),
f AS (SELECT docno, 'title' AS field, COALESCE(title, '') AS text FROM w
      UNION ALL SELECT docno, 'abstract' AS field, COALESCE(abstract, '') AS text FROM w
      UNION ALL SELECT docno, 'url' AS field, COALESCE(url, '') AS text FROM w)
SELECT field, term, docno, CAST(COUNT(*) AS BIGINT) AS tf
FROM (SELECT docno, field, unnest({toks('text')}) AS term FROM f) GROUP BY field, term, docno"""
ORACLE["doc_meta"] = """
SELECT CAST(doc_id AS VARCHAR) AS docno, substr(text, 1, 64) AS text, substr(source, 1, 8) AS source
FROM documents"""

# -------------------------------------------------------------- retrieval --
for key, model in [("bm25_topk", "BM25"), ("tfidf_topk", "TF_IDF"),
                   ("dirichlet_topk", "DirichletLM"), ("pl2_topk", "PL2"), ("dph_topk", "DPH")]:
    ORACLE[key] = run_ctes(model, 10) + " SELECT qid, docno, score, rank FROM run"
ORACLE["bm25_raw_terms"] = run_ctes("BM25", 10, stop=False) + " SELECT qid, docno, score, rank FROM run"
ORACLE["search_one"] = run_ctes(
    "BM25", 10, topics_cte="topics AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query "
    "FROM benchmark ORDER BY CAST(item_id AS VARCHAR) LIMIT 1)") + \
    " SELECT qid, docno, score, rank FROM run"
ORACLE["bm25_with_meta"] = run_ctes("BM25", 10) + """
SELECT r.docno, r.qid, r.score, r.rank, d.lang, d.source FROM run r LEFT JOIN docs d ON d.docno = r.docno"""
ORACLE["rescore_candidates"] = run_ctes("BM25", 50, name="cand") + """,
pl AS (SELECT qid, docno, SUM(""" + model_sql("PL2") + """) AS s
       FROM m WHERE (qid, docno) IN (SELECT qid, docno FROM cand) GROUP BY qid, docno),
j AS (SELECT c.qid, c.docno, c.score AS score_0, round(COALESCE(p.s, 0.0), 6) AS score
      FROM cand c LEFT JOIN pl p ON p.qid = c.qid AND p.docno = c.docno)
SELECT qid, docno, score_0, score,
       CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS BIGINT) AS rank
FROM j"""


ORACLE["rerank_pipeline"] = run_ctes("BM25", 100, name="cand") + """,
pl AS (SELECT qid, docno, SUM(""" + model_sql("PL2") + """) AS s
       FROM m WHERE (qid, docno) IN (SELECT qid, docno FROM cand) GROUP BY qid, docno),
j AS (SELECT c.qid, c.docno, c.score AS score_0, round(COALESCE(p.s, 0.0), 6) AS score
      FROM cand c LEFT JOIN pl p ON p.qid = c.qid AND p.docno = c.docno),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS BIGINT) AS rank FROM j)
SELECT qid, docno, score_0, score, rank FROM ranked WHERE rank < 20"""


def _multi():
    return run_ctes("BM25", 10) + f""",
f AS (SELECT qid, docno, round(SUM({model_sql('PL2')}), 6) AS f_pl2,
             round(SUM({model_sql('DPH')}), 6) AS f_dph FROM m GROUP BY qid, docno)
SELECT r.qid, r.docno, r.score, r.rank, f.f_pl2, f.f_dph
FROM run r JOIN f ON f.qid = r.qid AND f.docno = r.docno"""


ORACLE["multi_model_features"] = _multi()

# ------------------------------------------------------------- evaluation --
EVAL_RUN = run_ctes("BM25", 1000) + "," + QRELS


def _pq(metrics):
    return (EVAL_RUN + "," + per_query_ctes(metrics)
            + " SELECT qid, metric, round(value, 6) AS value FROM pq")


ORACLE["eval_map"] = _pq(["map"])
ORACLE["eval_ndcg"] = _pq(["ndcg", "ndcg_cut_10"])
ORACLE["eval_precision"] = _pq(["P_5", "P_10"])
ORACLE["eval_recall"] = _pq(["recall_10", "recall_100"])
ORACLE["eval_rr"] = _pq(["RR@10"])
ORACLE["eval_ap_rel3"] = _pq(["AP(rel=3)"])
ORACLE["evaluate_run"] = (EVAL_RUN + "," + per_query_ctes(DISPLAY)
                          + " SELECT metric, round(AVG(value), 6) AS value FROM pq GROUP BY metric")
ORACLE["judge_run"] = run_ctes("BM25", 100) + "," + QRELS + """
SELECT r.qid, r.docno, r.score, COALESCE(q.label, 0) AS label
FROM run r LEFT JOIN qrels q ON q.qid = r.qid AND q.docno = r.docno"""
_SPLIT = """train AS (SELECT qid FROM (SELECT CAST(item_id AS VARCHAR) AS qid,
   CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 4)) AS BIGINT) % 10 AS bucket FROM benchmark)
   WHERE bucket <= 5)"""
ORACLE["eval_subset"] = (EVAL_RUN + "," + _SPLIT + """,
run_s AS (SELECT * FROM run WHERE qid IN (SELECT qid FROM train)),
qrels_s AS (SELECT * FROM qrels WHERE qid IN (SELECT qid FROM train)),""" +
                         per_query_ctes(["map", "P_10"], run="run_s", qrels="qrels_s") +
                         " SELECT metric, round(AVG(value), 6) AS value FROM pq GROUP BY metric")


# ===================================================== part 2 (registry_ext) ==
from ..functions.text import ENGLISH_STOPWORDS, LINE_SPLIT_PATTERN  # noqa: E402
from ..operators import rewrite as _rw  # noqa: E402  (fixed prompt texts only)
from .oracle import matched_cte, qterms_cte, scored_cte, topk_cte  # noqa: E402

SAN = (r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), "
       r"'\s+', ' ', 'g'))")


def san(x):
    return SAN.format(x=x)


def misspell(x):
    return (f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN length(w) > 4 "
            f"THEN substr(w, 1, length(w) % 3 + 1) || substr(w, length(w) % 3 + 3) ELSE w END), ' ')")


def strip_ws(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x):
    s = strip_ws(x)
    s = rf"regexp_replace({s}, '^[\-\*\d\.\)]+\s*', '')"
    s = f"regexp_replace({s}, '^[\"''`]+|[\"''`]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({s}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


def lines(x):
    return f"regexp_split_to_array({strip_ws(x)}, '{LINE_SPLIT_PATTERN}')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CONV = """
seq AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
conv AS (SELECT conv_id, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, text AS query,
           CASE WHEN next_role = 'assistant' THEN next_text END AS raw
         FROM seq WHERE role = 'user' AND text IS NOT NULL)"""

BASE = "WITH " + index_ctes() + ",\n" + TOPICS + "," + qterms_cte() + "," + matched_cte()


def add_run(model, k, name, m="m"):
    return "," + scored_cte(model, m, f"sc_{name}") + "," + topk_cte(f"sc_{name}", k, name)


# ------------------------------------------------------------- rewriting --
ORACLE["rewrite_prefix"] = f"""
SELECT qid, {misspell(san('query'))} AS query, {san('query')} AS query_0, query AS query_1
FROM (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)"""
ORACLE["sanitize_query"] = "WITH " + CONV + f" SELECT qid, {san('query')} AS query FROM conv"

SDM_CL = """,
qtok AS (SELECT qid, toks FROM (SELECT qid, """ + toks("query") + """ AS toks FROM topics)),
qpos AS (SELECT qid, unnest(toks) AS a, generate_subscripts(toks, 1) AS i FROM qtok),
qpairs AS (SELECT x.qid, x.a, y.a AS b FROM qpos x JOIN qpos y ON y.qid = x.qid AND y.i = x.i + 1),
cl AS (
  SELECT qid, 'u' AS kind, a AS clause, a, CAST(NULL AS VARCHAR) AS b, COUNT(*) * CAST(0.85 AS DOUBLE) AS weight FROM qpos GROUP BY qid, a
  UNION ALL SELECT qid, 'o', '#1(' || a || ' ' || b || ')', a, b, COUNT(*) * CAST(0.1 AS DOUBLE) FROM qpairs GROUP BY qid, a, b
  UNION ALL SELECT qid, 'w', '#uw8(' || a || ' ' || b || ')', a, b, COUNT(*) * CAST(0.05 AS DOUBLE) FROM qpairs GROUP BY qid, a, b)"""
ORACLE["sdm_clauses"] = BASE + SDM_CL + " SELECT qid, kind, clause, round(weight, 6) AS weight FROM cl"
ORACLE["sdm_bm25"] = BASE + SDM_CL + """,
dpos AS (SELECT docno, unnest(toks) AS term, generate_subscripts(toks, 1) AS p FROM dtoks),
prs AS (SELECT DISTINCT kind, clause, a, b FROM cl WHERE kind <> 'u'),
hits AS (SELECT r.clause, x.docno FROM prs r JOIN dpos x ON x.term = r.a
         JOIN dpos y ON y.term = r.b AND y.docno = x.docno
         AND ((r.kind = 'o' AND y.p = x.p + 1) OR (r.kind = 'w' AND y.p <> x.p AND abs(y.p - x.p) < 8))),
ppost AS (SELECT clause AS term, docno, COUNT(*) AS tf FROM hits GROUP BY clause, docno),
plex AS (SELECT term, COUNT(*) AS df, SUM(tf) AS cf FROM ppost GROUP BY term),
allpost AS (SELECT term, docno, tf FROM post UNION ALL SELECT term, docno, tf FROM ppost),
alllex AS (SELECT term, df, cf FROM lex UNION ALL SELECT term, df, cf FROM plex),
sq AS (SELECT qid, clause AS term, weight AS qtf, SUM(weight) OVER (PARTITION BY qid) AS qlen FROM cl),
m2 AS (SELECT q.qid, q.term, q.qtf, q.qlen, l.df, l.cf, p.docno, p.tf, d.dl, s.n, s.c, s.avgdl
       FROM sq q JOIN alllex l ON l.term = q.term JOIN allpost p ON p.term = q.term
       JOIN dl d ON d.docno = p.docno CROSS JOIN stats s)""" + add_run("BM25", 10, "run", "m2") + \
    " SELECT qid, docno, score, rank FROM run"

FB = add_run("BM25", 3, "fb") + """,
fbp AS (SELECT f.qid, f.docno, f.score, p.term, p.tf, d.dl FROM fb f JOIN post p ON p.docno = f.docno
        JOIN dl d ON d.docno = f.docno)"""
BO1 = FB + """,
tfx AS (SELECT qid, term, CAST(SUM(tf) AS DOUBLE) AS tfx FROM fbp GROUP BY qid, term),
bw AS (SELECT t.qid, t.term, t.tfx * log2((1 + CAST(l.cf AS DOUBLE) / s.n) / (CAST(l.cf AS DOUBLE) / s.n))
              + log2(1 + CAST(l.cf AS DOUBLE) / s.n) AS w
       FROM tfx t JOIN lex l ON l.term = t.term CROSS JOIN stats s),
btop AS (SELECT qid, term, w FROM bw QUALIFY row_number() OVER (PARTITION BY qid ORDER BY w DESC, term ASC) <= 10),
bm AS (SELECT COALESCE(o.qid, t.qid) AS qid, COALESCE(o.term, t.term) AS term, o.qtf, t.w
       FROM qt o FULL OUTER JOIN btop t ON t.qid = o.qid AND t.term = o.term),
bo1 AS (SELECT qid, term, COALESCE(qtf, 0) / MAX(qtf) OVER (PARTITION BY qid)
               + COALESCE(w / MAX(w) OVER (PARTITION BY qid), 0) AS qtf FROM bm)"""
RM3 = FB + """,
pqd AS (SELECT qid, docno, score / SUM(score) OVER (PARTITION BY qid) AS pq FROM fb),
pr AS (SELECT b.qid, b.term, SUM(CAST(b.tf AS DOUBLE) / b.dl * p.pq) AS pr
       FROM fbp b JOIN pqd p ON p.qid = b.qid AND p.docno = b.docno GROUP BY b.qid, b.term),
rtop0 AS (SELECT qid, term, round(pr, 12) AS pr FROM pr QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pr DESC, term ASC) <= 10),
rtop AS (SELECT qid, term, pr / SUM(pr) OVER (PARTITION BY qid) AS pr FROM rtop0),
rm AS (SELECT COALESCE(o.qid, t.qid) AS qid, COALESCE(o.term, t.term) AS term, o.qtf, t.pr
       FROM qt o FULL OUTER JOIN rtop t ON t.qid = o.qid AND t.term = o.term),
rm3 AS (SELECT qid, term, CAST(0.6 AS DOUBLE) * COALESCE(qtf, 0) / SUM(qtf) OVER (PARTITION BY qid)
               + CAST(0.4 AS DOUBLE) * COALESCE(pr, 0) AS qtf FROM rm)"""


def weighted_run(src, k=10):
    return f""",
wq AS (SELECT qid, term, qtf, SUM(qtf) OVER (PARTITION BY qid) AS qlen FROM {src}),""" + \
        matched_cte("wq", "mw") + add_run("BM25", k, "run", "mw") + " SELECT qid, docno, score, rank FROM run"


ORACLE["bo1_terms"] = BASE + BO1 + " SELECT qid, term, round(qtf, 6) AS qtf FROM bo1"
ORACLE["bo1_bm25"] = BASE + BO1 + weighted_run("bo1")
ORACLE["rm3_terms"] = BASE + RM3 + " SELECT qid, term, round(qtf, 6) AS qtf FROM rm3"
ORACLE["rm3_bm25"] = BASE + RM3 + weighted_run("rm3")

# DuckDB's levenshtein counts bytes; for a character-level distance the
# accented Latin letters are mapped to single-byte characters that never occur
# in a token (upper case letters and symbols). Fixed values:
LATIN_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
ONE_BYTE_STANDINS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+"


def one_byte(x):
    return f"translate({x}, '{LATIN_ACCENTED}', '{ONE_BYTE_STANDINS}')"


ORACLE["spell_correct"] = "WITH " + index_ctes() + f""",
mt AS (SELECT CAST(item_id AS VARCHAR) AS qid, {misspell(san('text'))} AS query FROM benchmark),
words AS (SELECT qid, query, unnest(string_split(query, ' ')) AS word,
                 generate_subscripts(string_split(query, ' '), 1) AS pos FROM mt),
known AS (SELECT term AS word FROM lex UNION SELECT unnest([{', '.join(q(w) for w in ENGLISH_STOPWORDS)}])),
unk AS (SELECT DISTINCT word FROM words WHERE length(word) > 0 AND word NOT IN (SELECT word FROM known)),
cand AS (SELECT u.word, l.term, l.cf, levenshtein({one_byte('u.word')}, {one_byte('l.term')}) AS dist FROM unk u JOIN lex l
         ON abs(length(u.word) - length(l.term)) <= 2
         WHERE levenshtein({one_byte('u.word')}, {one_byte('l.term')}) <= 2),
best AS (SELECT word, term AS fix FROM cand
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist ASC, cf DESC, term ASC) = 1)
SELECT w.qid, string_agg(COALESCE(b.fix, w.word), ' ' ORDER BY w.pos) AS query, w.query AS query_0
FROM words w LEFT JOIN best b ON b.word = w.word GROUP BY w.qid, w.query"""

_exp_user = _rw.EXPANSION_USER_TEMPLATE.split("%s")
_mul_user = _rw.MULTI_USER_TEMPLATE.split("%s")
_rw_user = _rw.REWRITE_USER_TEMPLATE.split("%s")
ORACLE["build_prompts"] = "WITH " + CONV + """,
sy AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context FROM conversations
       WHERE role = 'system' GROUP BY conv_id)
SELECT c.qid, """ + q(_rw.EXPANSION_SYSTEM_PROMPT) + " AS system_prompt, " + \
    q(_exp_user[0]) + " || c.query || " + q(_exp_user[1]) + " AS user_prompt, " + \
    q(_rw.MULTI_SYSTEM_TEMPLATE % 3) + " AS multi_system, " + \
    q(_mul_user[0]) + " || c.query || " + q(_mul_user[1]) + " AS multi_user, " + \
    q(_rw.REWRITE_SYSTEM_PROMPT) + " AS rewrite_system, " + \
    q(_rw_user[0]) + " || COALESCE(s.context, '') || " + q(_rw_user[1]) + " || c.query || " + \
    q(_rw_user[2]) + " AS rewrite_user FROM conv c LEFT JOIN sy s ON s.conv_id = c.conv_id"
ORACLE["clean_generation"] = "WITH " + CONV + f""",
ls AS (SELECT qid, {lines('raw')} AS l FROM conv WHERE raw IS NOT NULL)
SELECT qid, CAST(i - 1 AS BIGINT) AS line_no, {clean('line')} AS cleaned
FROM (SELECT qid, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM ls)"""
PHR = f"list_filter(list_transform({lines('raw')}, lambda x: {clean('x')}), lambda p: length(p) > 0)"
EXPAND = "WITH " + CONV + f""",
ph AS (SELECT qid, query, raw, {PHR} AS ph FROM conv),
tk AS (SELECT qid, unnest(l) AS tok, generate_subscripts(l, 1) AS i
       FROM (SELECT qid, list_filter(regexp_split_to_array(lower(query || ' ' || array_to_string(ph, ' ')), '\\s+'),
                                     lambda t: length(t) > 0) AS l
             FROM ph WHERE raw IS NOT NULL AND len(ph) > 0)),
bag AS (SELECT qid, string_agg(tok, ' ' ORDER BY fi) AS bag FROM (SELECT qid, tok, MIN(i) AS fi FROM tk GROUP BY qid, tok) GROUP BY qid),
exp AS (SELECT p.qid, p.query AS original_query, CASE WHEN p.raw IS NULL OR len(p.ph) = 0 THEN p.query ELSE b.bag END AS query
        FROM ph p LEFT JOIN bag b ON b.qid = p.qid)"""
ORACLE["llm_expand"] = EXPAND + " SELECT qid, original_query, query FROM exp"
ORACLE["llm_expand_multi"] = "WITH " + CONV + f""",
al AS (SELECT qid, query, raw, list_filter(list_transform(list_filter({lines('raw')}, lambda l: length(trim(l)) > 0),
       lambda x: {clean('x')}), lambda p: length(p) > 0)[1:3] AS alts FROM conv)
SELECT qid, CASE WHEN raw IS NULL OR len(alts) = 0 THEN query ELSE query || ' ' || array_to_string(alts, ' ') END AS query FROM al"""
ORACLE["llm_rewrite"] = "WITH " + CONV + f" SELECT qid, COALESCE(NULLIF({clean(strip_ws('raw'))}, ''), query) AS query FROM conv"
ORACLE["llm_qe_bm25"] = (EXPAND.replace("WITH ", "WITH " + index_ctes() + ",", 1) + f""",
topics2 AS (SELECT qid, {san('query')} AS query FROM exp),""" + qterms_cte("topics2") + "," + matched_cte()
                         + add_run("BM25", 10, "run") + " SELECT qid, docno, score, rank FROM run")
ORACLE["rewrite_eval"] = (BASE + add_run("BM25", 1000, "r_orig") + ",\n" + QRELS + f""",
topics2 AS (SELECT qid, {san('query')} AS query FROM topics),""" + qterms_cte("topics2", name="qt2") + ","
                          + matched_cte("qt2", "m2") + add_run("BM25", 1000, "r_san", "m2") + ","
                          + per_query_ctes(["AP(rel=3)"], run="r_orig", name="pa") + ","
                          + per_query_ctes(["AP(rel=3)"], run="r_san", name="pb") + """
SELECT 'original' AS system, round(AVG(value), 6) AS value FROM pa
UNION ALL SELECT 'rewritten', round(AVG(value), 6) FROM pb""")

# --------------------------------------------------------------- algebra --
ORACLE["rank_cutoff"] = run_ctes("BM25", 5) + " SELECT qid, docno, score, rank FROM run"
ORACLE["linear_combine"] = BASE + add_run("TF_IDF", 100, "rt") + add_run("BM25", 100, "rb") + """,
u AS (SELECT qid, docno, score * CAST(2.0 AS DOUBLE) AS s FROM rt UNION ALL SELECT qid, docno, score FROM rb),
g AS (SELECT qid, docno, round(SUM(s), 6) AS score FROM u GROUP BY qid, docno)
SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS BIGINT) AS rank FROM g"""
ORACLE["feature_union"] = BASE + add_run("BM25", 10, "run") + f""",
fx AS (SELECT qid, docno, round(SUM({model_sql('PL2')}), 6) AS f1, round(SUM({model_sql('DPH')}), 6) AS f2
       FROM m WHERE (qid, docno) IN (SELECT qid, docno FROM run) GROUP BY qid, docno)
SELECT r.qid, r.docno, r.score, r.rank, r.score AS f0, COALESCE(f.f1, 0.0) AS f1, COALESCE(f.f2, 0.0) AS f2
FROM run r LEFT JOIN fx f ON f.qid = r.qid AND f.docno = r.docno"""

# ----------------------------------------------------------- experiments --
SYSTEMS = ["BM25", "TF_IDF", "DirichletLM"]
EXP = (BASE + "".join(add_run(s, 1000, f"r_{s}") for s in SYSTEMS) + ",\n" + QRELS + ","
       + ",".join(per_query_ctes(DISPLAY, run=f"r_{s}", name=f"p_{s}") for s in SYSTEMS) + ",\n"
       + "jq AS (SELECT DISTINCT qid FROM qrels WHERE qid IN (SELECT qid FROM topics)),\n"
       + "mets AS (SELECT unnest([" + ", ".join(q(m) for m in DISPLAY) + "]) AS metric),\n"
       + "pqall AS (" + " UNION ALL ".join(
           f"SELECT '{s}' AS system, j.qid, mt.metric, COALESCE(p.value, 0.0) AS value FROM jq j CROSS JOIN mets mt "
           f"LEFT JOIN p_{s} p ON p.qid = j.qid AND p.metric = mt.metric" for s in SYSTEMS) + "),\n"
       + "expm AS (SELECT system, metric, AVG(value) AS value FROM pqall GROUP BY system, metric)")
ORACLE["experiment"] = EXP + " SELECT system, metric, round(value, 6) AS value FROM expm"
TT = EXP + """,
bl AS (SELECT qid, metric, value AS b FROM pqall WHERE system = 'BM25'),
dd AS (SELECT o.system, o.metric, o.value - b.b AS d FROM pqall o JOIN bl b ON b.qid = o.qid AND b.metric = o.metric
       WHERE o.system <> 'BM25'),
g AS (SELECT system, metric, COUNT(*) AS n, AVG(d) AS mean_diff, stddev_samp(d) AS sd FROM dd GROUP BY system, metric),
tt AS (SELECT system, metric, n, mean_diff, CASE WHEN sd > 0 THEN mean_diff / (sd / sqrt(n)) END AS t, n - 1 AS nu FROM g),
th AS (SELECT *, atan(abs(t) / sqrt(CAST(nu AS DOUBLE))) AS theta FROM tt WHERE t IS NOT NULL AND n > 1),
ser AS (SELECT system, metric, j, CASE WHEN nu % 2 = 1 THEN (2.0 * j) / (2.0 * j + 1.0) ELSE (2.0 * j - 1.0) / (2.0 * j) END
               * cos(theta) * cos(theta) AS ratio
        FROM (SELECT *, unnest(generate_series(1, CAST(CASE WHEN nu % 2 = 1 THEN floor((nu - 3) / 2) ELSE floor((nu - 2) / 2) END AS BIGINT))) AS j
              FROM th)),
cp AS (SELECT system, metric, SUM(e) AS s FROM (SELECT system, metric, exp(SUM(ln(ratio)) OVER (PARTITION BY system, metric ORDER BY j)) AS e FROM ser)
       GROUP BY system, metric),
pv AS (SELECT h.system, h.metric, 1.0 - CASE WHEN h.nu = 1 THEN 2.0 * h.theta / pi()
              WHEN h.nu % 2 = 1 THEN 2.0 / pi() * (h.theta + sin(h.theta) * cos(h.theta) * (1.0 + COALESCE(c.s, 0.0)))
              ELSE sin(h.theta) * (1.0 + COALESCE(c.s, 0.0)) END AS p
       FROM th h LEFT JOIN cp c ON c.system = h.system AND c.metric = h.metric),
ttest AS (SELECT t.system, t.metric, t.n, t.mean_diff, t.t, p.p FROM tt t LEFT JOIN pv p ON p.system = t.system AND p.metric = t.metric)"""
ORACLE["paired_ttest"] = TT + """
SELECT system, metric, CAST(n AS BIGINT) AS n, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(p, 6) AS p FROM ttest"""
ORACLE["bonferroni"] = TT + """
SELECT system, metric, round(least(1.0, p * 2), 6) AS p_adj, COALESCE(p * 2 < 0.05, false) AS reject FROM ttest"""
ORACLE["compare_methods"] = EXP + " SELECT metric, " + ", ".join(
    f"round(MAX(CASE WHEN system = '{s}' THEN value END), 6) AS \"{s}\"" for s in SYSTEMS) + " FROM expm GROUP BY metric"
ORACLE["improvement_pct"] = EXP + """
SELECT e.metric, e.system, CASE WHEN b.value <> 0 THEN round((e.value - b.value) / b.value * CAST(100.0 AS DOUBLE), 2) END AS pct
FROM expm e JOIN expm b ON b.metric = e.metric AND b.system = 'BM25' WHERE e.system <> 'BM25'"""
ORACLE["best_method"] = EXP + """
SELECT metric, system AS best_system, round(value, 6) AS value FROM expm
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC,
   CASE system WHEN 'BM25' THEN 1 WHEN 'TF_IDF' THEN 2 ELSE 3 END) = 1"""
ORACLE["compare_with_stub"] = EXP + """,
sys AS (SELECT unnest(['BM25', 'TF_IDF', 'DirichletLM', 'failed_system']) AS system)
SELECT s.system, mt.metric, round(COALESCE(e.value, 0.0), 6) AS value,
       CASE WHEN e.value IS NULL THEN 'stub' ELSE 'ok' END AS status
FROM sys s CROSS JOIN mets mt LEFT JOIN expm e ON e.system = s.system AND e.metric = mt.metric"""
ORACLE["csv_metrics_roundtrip"] = ORACLE["evaluate_run"]
ORACLE["trec_run_lines"] = run_ctes("BM25", 10) + """
SELECT qid || ' Q0 ' || docno || ' ' || CAST(rank AS VARCHAR) || ' ' || printf('%.6f', score) || ' bm25' AS line FROM run"""

# ----------------------------------------------------------------- dense --


def hsparse(src, idc, textc, name):
    return f"""
{name}_t AS (SELECT {idc} AS id, md5(t) AS h FROM (SELECT {idc}, unnest({toks(textc)}) AS t FROM {src})),
{name}_c AS (SELECT id, CAST(('0x' || substr(h, 1, 4)) AS BIGINT) % 64 AS dim,
                 CASE WHEN CAST(('0x' || substr(h, 5, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM {name}_t),
{name}_v AS (SELECT id, dim, CAST(SUM(s) AS DOUBLE) AS v FROM {name}_c GROUP BY id, dim HAVING SUM(s) <> 0),
{name} AS (SELECT v.id, v.dim, v.v / n.norm AS value FROM {name}_v v
           JOIN (SELECT id, sqrt(SUM(v * v)) AS norm FROM {name}_v GROUP BY id) n ON n.id = v.id)"""


ORACLE["hash_encode"] = "WITH " + TOPICS + "," + hsparse("topics", "qid", "query", "qv") + \
    " SELECT id AS qid, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM qv"


def dense_ctes(depth):
    return BASE + add_run("BM25", depth, "cand") + "," + hsparse("topics", "qid", "query", "qv") + "," + \
        hsparse("docs", "docno", "text", "dv") + """,
dots AS (SELECT c.qid, c.docno, SUM(q.value * d.value) AS s FROM cand c JOIN qv q ON q.id = c.qid
         JOIN dv d ON d.id = c.docno AND d.dim = q.dim GROUP BY c.qid, c.docno),
dn0 AS (SELECT c.qid, c.docno, c.score AS score_0, round(COALESCE(x.s, 0.0), 6) + 0.0 AS score FROM cand c
        LEFT JOIN dots x ON x.qid = c.qid AND x.docno = c.docno),
dn AS (SELECT qid, docno, score_0, score,
              CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS BIGINT) AS rank FROM dn0)"""


DENSE = dense_ctes(100)
ORACLE["dense_rerank"] = DENSE + " SELECT qid, docno, score_0, score, rank FROM dn"
ORACLE["dense_reopen"] = ORACLE["dense_rerank"]
ORACLE["dense_best"] = DENSE + " SELECT qid, docno, score_0, score, rank FROM dn WHERE rank < 10"
ORACLE["dense_maxp"] = BASE + add_run("BM25", 100, "cand") + "," + hsparse("topics", "qid", "query", "qv") + """,
psg AS (SELECT docno || '#' || CAST(i - 1 AS VARCHAR) AS pid, docno, ptext
        FROM (SELECT docno, unnest(string_split(text, chr(10))) AS ptext, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),""" + \
    hsparse("psg", "pid", "ptext", "pv") + """,
pdoc AS (SELECT DISTINCT v.id AS pid, p.docno FROM pv v JOIN psg p ON p.pid = v.id),
pdots AS (SELECT c.qid, pd.pid, pd.docno, COALESCE(SUM(q.value * v.value), 0.0) AS s
          FROM cand c JOIN pdoc pd ON pd.docno = c.docno JOIN qv q ON q.id = c.qid
          LEFT JOIN pv v ON v.id = pd.pid AND v.dim = q.dim GROUP BY c.qid, pd.pid, pd.docno),
mx AS (SELECT qid, docno, MAX(s) AS s FROM pdots GROUP BY qid, docno),
m0 AS (SELECT c.qid, c.docno, c.score AS score_0, round(COALESCE(x.s, 0.0), 6) + 0.0 AS score FROM cand c LEFT JOIN mx x ON x.qid = c.qid AND x.docno = c.docno)
SELECT qid, docno, score_0, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS BIGINT) AS rank FROM m0"""
INTERP = """,
ip AS (SELECT qid, docno, score_0, round(CAST(0.3 AS DOUBLE) * score_0 + CAST(0.7 AS DOUBLE) * score, 9) AS score FROM dn),
ipr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) - 1 AS BIGINT) AS rank FROM ip)"""
ORACLE["interpolate"] = DENSE + INTERP + " SELECT qid, docno, score_0, score, rank FROM ipr"
ORACLE["hybrid_rank"] = dense_ctes(1000) + INTERP + " SELECT qid, docno, score_0, score, rank FROM ipr WHERE rank < 10"
ORACLE["grid_search_alpha"] = DENSE + ",\n" + QRELS + """,
al AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS alpha),
dev AS (SELECT qid FROM (SELECT CAST(item_id AS VARCHAR) AS qid,
        CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 4)) AS BIGINT) % 10 AS bucket FROM benchmark) WHERE bucket IN (6, 7)),
gr AS (SELECT CAST(a.alpha AS VARCHAR) || '|' || d.qid AS qid, d.docno,
              round(a.alpha * d.score_0 + (CAST(1.0 AS DOUBLE) - a.alpha) * d.score, 9) AS score
       FROM dn d CROSS JOIN al a WHERE d.qid IN (SELECT qid FROM dev)),
gq AS (SELECT CAST(a.alpha AS VARCHAR) || '|' || q.qid AS qid, q.docno, q.label FROM qrels q CROSS JOIN al a),""" + \
    per_query_ctes(["map"], run="gr", qrels="gq", name="gp") + """,
gm AS (SELECT CAST(split_part(qid, '|', 1) AS DOUBLE) AS alpha, AVG(value) AS map FROM gp GROUP BY 1)
SELECT alpha, round(map, 6) AS map, row_number() OVER (ORDER BY map DESC, alpha ASC) = 1 AS best FROM gm"""

ORACLE["grid_search"] = DENSE + ",\n" + QRELS + """,
st AS (SELECT k, alpha, CAST(k AS VARCHAR) || '|' || CAST(alpha AS VARCHAR) AS name
       FROM (SELECT unnest([5, 100]::BIGINT[]) AS k) CROSS JOIN (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS alpha)),
dev AS (SELECT qid FROM (SELECT CAST(item_id AS VARCHAR) AS qid,
        CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 4)) AS BIGINT) % 10 AS bucket FROM benchmark) WHERE bucket IN (6, 7)),
cr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score_0 DESC, docno ASC) AS place FROM dn WHERE qid IN (SELECT qid FROM dev)),
gr AS (SELECT s.name || '|' || d.qid AS qid, d.docno,
              round(s.alpha * d.score_0 + (CAST(1.0 AS DOUBLE) - s.alpha) * d.score, 9) AS score
       FROM cr d JOIN st s ON d.place <= s.k),
gq AS (SELECT s.name || '|' || q.qid AS qid, q.docno, q.label FROM qrels q CROSS JOIN st s WHERE q.qid IN (SELECT qid FROM dev)),""" + \
    per_query_ctes(["map"], run="gr", qrels="gq", name="gp") + """,
gm AS (SELECT s.k, s.alpha, AVG(COALESCE(g.value, CAST(0.0 AS DOUBLE))) AS map
       FROM st s JOIN (SELECT DISTINCT qid FROM qrels WHERE qid IN (SELECT qid FROM dev)) j ON TRUE
       LEFT JOIN gp g ON g.qid = s.name || '|' || j.qid GROUP BY s.k, s.alpha)
SELECT k, alpha, round(map, 6) AS map, row_number() OVER (ORDER BY round(map, 9) DESC, k ASC, alpha ASC) = 1 AS best FROM gm"""

# ------------------------------------------------------------------- LTR --
JAC = lambda a, b: f"CASE WHEN len(list_distinct({a})) + len(list_distinct({b})) - len(list_intersect(list_distinct({a}), list_distinct({b}))) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct({a}), list_distinct({b}))) AS DOUBLE) / (len(list_distinct({a})) + len(list_distinct({b})) - len(list_intersect(list_distinct({a}), list_distinct({b})))) END"
QT_SET = TOK.format(x="t.query")
TITLE_SET = TOK.format(x="string_split(d.text, chr(10))[1]")
ABS_SET = TOK.format(x="d.text")


def jac_cte(run):
    return f""",
jf AS (SELECT r.qid, r.docno, {JAC(QT_SET, TITLE_SET)} AS j_title, {JAC(QT_SET, ABS_SET)} AS j_abstract
       FROM {run} r JOIN topics t ON t.qid = r.qid JOIN docs d ON d.docno = r.docno)"""


ORACLE["jaccard_features"] = BASE + add_run("BM25", 10, "run") + jac_cte("run") + \
    " SELECT qid, docno, round(j_title, 6) AS j_title, round(j_abstract, 6) AS j_abstract FROM jf"
ORACLE["scalar_features"] = BASE + add_run("BM25", 10, "run") + """
SELECT r.qid, r.docno, r.score AS f_score, CAST(d.n_chars AS DOUBLE) AS f_len
FROM run r LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.docno"""
LTRF = BASE + add_run("BM25", 100, "cand") + jac_cte("cand") + f""",
mf AS (SELECT qid, docno, round(SUM({model_sql('PL2')}), 6) AS pl2, round(SUM({model_sql('DPH')}), 6) AS dph,
              round(SUM({model_sql('BM25')}), 6) AS bm25 FROM m GROUP BY qid, docno),
lf AS (SELECT c.qid, c.docno, c.score, c.rank, round(COALESCE(j.j_title, 0.0), 6) AS f0, round(COALESCE(j.j_abstract, 0.0), 6) AS f1,
              round(mf.pl2, 6) AS f2, round(mf.dph, 6) AS f3, round(mf.bm25, 6) AS f4,
              round(COALESCE(CAST(d.n_chars AS DOUBLE), 0.0), 6) AS f5
       FROM cand c LEFT JOIN jf j ON j.qid = c.qid AND j.docno = c.docno
       LEFT JOIN mf ON mf.qid = c.qid AND mf.docno = c.docno
       LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.docno)"""
ORACLE["ltr_features"] = LTRF + " SELECT qid, docno, score, rank, f0, f1, f2, f3, f4, f5 FROM lf"
ORACLE["single_topic_features"] = LTRF + """
SELECT qid, docno, score, rank, f0, f1, f2, f3, f4, f5 FROM lf WHERE qid = (SELECT MIN(qid) FROM topics)"""
ORACLE["ltr_training_set"] = LTRF + ",\n" + QRELS + "," + _SPLIT + """
SELECT l.qid, l.docno, COALESCE(q.label, 0) AS label, f0, f1, f2, f3, f4, f5
FROM lf l LEFT JOIN qrels q ON q.qid = l.qid AND q.docno = l.docno WHERE l.qid IN (SELECT qid FROM train)"""
ORACLE["ablate_features"] = LTRF + " SELECT qid, docno, f1 AS f0, f2 AS f1, f3 AS f2, f4 AS f3, f5 AS f4 FROM lf"
ORACLE["keep_features"] = LTRF + " SELECT qid, docno, f1 AS f0, f3 AS f1 FROM lf"
ORACLE["inline_topics"] = run_ctes("BM25", 10, topics_cte=(
    "topics AS (SELECT * FROM (VALUES ('q1', 'information retrieval'), ('q2', 'the thesher'), "
    "('q3', 'ciónue de las')) v(qid, query))")) + " SELECT qid, docno, score, rank FROM run"

# the cached stage must return what the plain one does
ORACLE["cached_retrieve"] = ORACLE["bm25_topk"]

# a reopened index must return what the one in memory does
for key, same in [("stored_bm25", "bm25_topk"), ("stored_bo1", "bo1_bm25"), ("stored_rm3", "rm3_bm25"),
                  ("stored_sdm", "sdm_bm25")]:
    ORACLE[key] = ORACLE[same]
