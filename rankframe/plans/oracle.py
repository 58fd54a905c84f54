"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Written from the semantics sheet, not generated from the Spark plans: plain
CTEs over the pre-registered driver tables, window functions for ranks and
running counts, the ideal DCG by row_number over the judgments. Literals are
cast to DOUBLE so DuckDB does not fall back to DECIMAL arithmetic.
"""

from __future__ import annotations

import math

from ..functions.text import ENGLISH_STOPWORDS

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS) + ")"
TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def D(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def toks(x: str, stop: bool = True) -> str:
    base = TOK.format(x=x)
    if not stop:
        return f"list_filter({base}, lambda t: length(t) <= 20)"
    return f"list_filter({base}, lambda t: length(t) <= 20 AND t NOT IN {STOP_SQL})"


def index_ctes(stop: bool = True) -> str:
    return f"""
docs AS (SELECT CAST(doc_id AS VARCHAR) AS docno, text, lang, source FROM documents),
dtoks AS (SELECT docno, {toks('text', stop)} AS toks FROM docs),
dl AS (SELECT docno, CAST(len(toks) AS BIGINT) AS dl FROM dtoks),
post AS (SELECT term, docno, CAST(COUNT(*) AS BIGINT) AS tf
         FROM (SELECT docno, unnest(toks) AS term FROM dtoks) GROUP BY term, docno),
lex AS (SELECT term, CAST(COUNT(*) AS BIGINT) AS df, CAST(SUM(tf) AS BIGINT) AS cf
        FROM post GROUP BY term),
stats AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(dl) AS DOUBLE) AS c,
                 CAST(SUM(dl) AS DOUBLE) / COUNT(*) AS avgdl FROM dl)"""


TOPICS = "topics AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)"


def qterms_cte(topics: str = "topics", stop: bool = True, name: str = "qt") -> str:
    return f"""
{name}0 AS (SELECT qid, term, CAST(COUNT(*) AS DOUBLE) AS qtf
        FROM (SELECT qid, unnest({toks('query', stop)}) AS term FROM {topics})
        GROUP BY qid, term),
{name} AS (SELECT qid, term, qtf, SUM(qtf) OVER (PARTITION BY qid) AS qlen FROM {name}0)"""


def matched_cte(qt: str = "qt", name: str = "m") -> str:
    return f"""
{name} AS (SELECT q.qid, q.term, q.qtf, q.qlen, l.df, l.cf, p.docno, p.tf, d.dl, s.n, s.c, s.avgdl
      FROM {qt} q JOIN lex l ON l.term = q.term JOIN post p ON p.term = q.term
      JOIN dl d ON d.docno = p.docno CROSS JOIN stats s)"""


LOG2E = 1.0 / math.log(2.0)


def model_sql(model: str) -> str:
    """Per-posting contribution over columns tf, dl, df, cf, qtf, n, c, avgdl."""
    tf, dl, df, cf, qtf = ("CAST(tf AS DOUBLE)", "CAST(dl AS DOUBLE)", "CAST(df AS DOUBLE)",
                           "CAST(cf AS DOUBLE)", "qtf")
    if model == "BM25":
        return (f"{qtf} * ln({D(1.0)} + (n - {df} + {D(0.5)}) / ({df} + {D(0.5)})) * "
                f"({tf} * {D(2.2)} / ({tf} + {D(1.2)} * ({D(0.25)} + {D(0.75)} * {dl} / avgdl)))")
    if model == "TF_IDF":
        return (f"{qtf} * ({D(1.2)} * {tf} / ({tf} + {D(1.2)} * ({D(0.25)} + {D(0.75)} * {dl} / avgdl)))"
                f" * log2(n / {df} + {D(1.0)})")
    if model == "DirichletLM":
        return f"{qtf} * ln({D(1.0)} + {tf} / ({D(2500.0)} * {cf} / c))"
    if model == "PL2":
        tfn = f"({tf} * log2({D(1.0)} + {D(1.0)} * avgdl / {dl}))"
        lam = f"({cf} / n)"
        return (f"{qtf} / ({tfn} + {D(1.0)}) * ({tfn} * log2({tfn} / {lam}) + ({lam} - {tfn}) * "
                f"{D(LOG2E)} + {D(0.5)} * log2({D(2.0 * math.pi)} * {tfn}))")
    if model == "DPH":
        f = f"({tf} / {dl})"
        return (f"CASE WHEN {f} >= {D(1.0)} THEN {D(0.0)} ELSE {qtf} * ({D(1.0)} - {f}) * "
                f"({D(1.0)} - {f}) / ({tf} + {D(1.0)}) * ({tf} * log2({tf} * avgdl / {dl} * n / {cf})"
                f" + {D(0.5)} * log2({D(2.0 * math.pi)} * {tf} * ({D(1.0)} - {f}))) END")
    raise ValueError(model)


def scored_cte(model: str, m: str = "m", name: str = "sc") -> str:
    extra = ""
    if model == "DirichletLM":
        extra = f" + ANY_VALUE(qlen) * ln({D(2500.0)} / (CAST(ANY_VALUE(dl) AS DOUBLE) + {D(2500.0)}))"
    return f"""
{name} AS (SELECT qid, docno, SUM({model_sql(model)}){extra} AS raw_score FROM {m} GROUP BY qid, docno)"""


def topk_cte(src: str, k: int | None, name: str = "run") -> str:
    cut = f"WHERE rn <= {k}" if k is not None else ""
    return f"""
{name} AS (SELECT qid, docno, score, CAST(rn - 1 AS BIGINT) AS rank FROM (
   SELECT qid, docno, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) AS rn
   FROM (SELECT qid, docno, round(raw_score, 6) AS score FROM {src})) {cut})"""


def run_ctes(model: str = "BM25", k: int | None = 10, stop: bool = True, name: str = "run",
             topics_cte: str = TOPICS) -> str:
    return ("WITH " + index_ctes(stop) + ",\n" + topics_cte + "," + qterms_cte(stop=stop) + ","
            + matched_cte() + "," + scored_cte(model) + "," + topk_cte("sc", k, name))


QRELS = """
qrels AS (SELECT DISTINCT CAST(b.item_id AS VARCHAR) AS qid, CAST(d.doc_id AS VARCHAR) AS docno,
                 CAST(1 + 2 * COALESCE(l.quality, 0) AS INTEGER) AS label
          FROM benchmark b JOIN documents d ON contains(d.text, b.text)
          LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def metric_sql(metric: str) -> tuple[str, str]:
    """(per-query numerator over judged rows ``x``, final expression using
    R<rel> and idcg_<k>)."""
    from ..operators.evaluate import parse_metric  # name parsing only
    m = parse_metric(metric)
    k, rel = m.k, m.rel
    ink = "TRUE" if k is None else f"r <= {k}"
    relf = f"label >= {rel}"
    if m.measure == "ap":
        return (f"SUM(CASE WHEN {relf} AND {ink} THEN CAST(cum{rel} AS DOUBLE) / r ELSE {D(0.0)} END)",
                f"CASE WHEN R{rel} > 0 THEN x / R{rel} ELSE {D(0.0)} END")
    if m.measure in ("p", "recall"):
        num = f"SUM(CASE WHEN {relf} AND {ink} THEN {D(1.0)} ELSE {D(0.0)} END)"
        fin = (f"x / {D(float(k))}" if m.measure == "p"
               else f"CASE WHEN R{rel} > 0 THEN x / R{rel} ELSE {D(0.0)} END")
        return num, fin
    if m.measure == "rr":
        return (f"MAX(CASE WHEN {relf} AND {ink} THEN {D(1.0)} / r ELSE {D(0.0)} END)", "x")
    kk = "all" if k is None else str(k)
    return (f"SUM(CASE WHEN {ink} THEN CAST(GREATEST(label, 0) AS DOUBLE) / log2(r + {D(1.0)}) ELSE {D(0.0)} END)",
            f"CASE WHEN COALESCE(idcg_{kk}, 0) > 0 THEN x / idcg_{kk} ELSE {D(0.0)} END")


def per_query_ctes(metrics: list[str], run: str = "run", qrels: str = "qrels",
                   name: str = "pq") -> str:
    """CTEs ending in ``name``(qid, metric, value) for queries in run ∩ qrels."""
    parts = [f"""
{name}_rk AS (SELECT qid, docno, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno ASC) AS r FROM {run}),
{name}_j AS (SELECT k.qid, k.docno, k.r, COALESCE(q.label, 0) AS label FROM {name}_rk k
          LEFT JOIN {qrels} q ON q.qid = k.qid AND q.docno = k.docno),
{name}_jc AS (SELECT *,
   SUM(CASE WHEN label >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum1,
   SUM(CASE WHEN label >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum2,
   SUM(CASE WHEN label >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum3
   FROM {name}_j),
{name}_qs AS (SELECT qid,
   SUM(CASE WHEN label >= 1 THEN {D(1.0)} ELSE {D(0.0)} END) AS R1,
   SUM(CASE WHEN label >= 2 THEN {D(1.0)} ELSE {D(0.0)} END) AS R2,
   SUM(CASE WHEN label >= 3 THEN {D(1.0)} ELSE {D(0.0)} END) AS R3 FROM {qrels} GROUP BY qid),
{name}_id AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY label DESC) AS i FROM {qrels} WHERE label > 0),
{name}_idcg AS (SELECT qid,
   SUM(label / log2(i + {D(1.0)})) AS idcg_all,
   SUM(CASE WHEN i <= 10 THEN label / log2(i + {D(1.0)}) ELSE {D(0.0)} END) AS idcg_10,
   SUM(CASE WHEN i <= 20 THEN label / log2(i + {D(1.0)}) ELSE {D(0.0)} END) AS idcg_20
   FROM {name}_id GROUP BY qid)"""]
    selects = []
    for i, m in enumerate(metrics):
        num, fin = metric_sql(m)
        parts.append(f"""
{name}_x{i} AS (SELECT s.qid, s.x, qs.R1, qs.R2, qs.R3, ig.idcg_all, ig.idcg_10, ig.idcg_20
   FROM (SELECT qid, {num} AS x FROM {name}_jc GROUP BY qid) s
   JOIN {name}_qs qs ON qs.qid = s.qid LEFT JOIN {name}_idcg ig ON ig.qid = s.qid)""")
        selects.append(f"SELECT qid, '{m}' AS metric, CAST({fin} AS DOUBLE) AS value FROM {name}_x{i}")
    parts.append(f"\n{name} AS (" + " UNION ALL ".join(selects) + ")")
    return ",".join(parts)


def r6(x: str) -> str:
    return f"round({x}, 6)"
