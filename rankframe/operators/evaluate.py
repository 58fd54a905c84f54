"""IR evaluation as grouped aggregations.

Per-query metrics are computed in one pass: the run is ranked per query
(order: score desc, docno asc — stored ranks are ignored), left-joined to the
judgments, and one ``groupBy(qid)`` evaluates every requested metric. The
ideal DCG is computed from label counts per (qid, label) in chunks, so no
window ever sorts a whole (possibly huge) judgment group in one task.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast

# Chunk length used to sum 1/log2(i+1) over long ideal rankings.
IDEAL_CHUNK = 100_000
# Steps of the incomplete beta behind a p-value: 1e-12 for every number of queries.
BETA_STEPS = 120


@dataclass(frozen=True)
class Metric:
    name: str
    measure: str            # ap | ndcg | p | recall | rr
    k: int | None = None    # cutoff
    rel: int = 1            # relevance threshold (label >= rel)


_PATTERNS = [
    (r"map", "ap", None), (r"ndcg", "ndcg", None), (r"recip_rank", "rr", None),
    (r"RR", "rr", None), (r"AP", "ap", None), (r"MAP", "ap", None),
    (r"nDCG", "ndcg", None),
    (r"map_cut_(\d+)", "ap", 1), (r"ndcg_cut_(\d+)", "ndcg", 1),
    (r"P_(\d+)", "p", 1), (r"recall_(\d+)", "recall", 1),
    (r"(?:AP|MAP)@(\d+)", "ap", 1), (r"nDCG@(\d+)", "ndcg", 1), (r"RR@(\d+)", "rr", 1),
    (r"P@(\d+)", "p", 1), (r"R@(\d+)", "recall", 1),
]


def parse_metric(name: str) -> Metric:
    """Accepts trec names (map, ndcg_cut_10, P_5, recall_100, recip_rank),
    measure@k names (nDCG@10, RR@10, AP@100) and a ``(rel=N)`` suffix on the
    measure (``AP(rel=3)``, ``RR(rel=2)@10``)."""
    base, rel = name, 1
    m = re.fullmatch(r"(\w+)\(rel=(\d+)\)(@\d+)?", name)
    if m:
        base, rel = m.group(1) + (m.group(3) or ""), int(m.group(2))
    for pat, measure, grp in _PATTERNS:
        mm = re.fullmatch(pat, base)
        if mm:
            k = int(mm.group(grp)) if grp else None
            return Metric(name, measure, k, rel)
    raise ValueError(f"unknown metric {name!r}")


def normalize_run(run: DataFrame, order_col: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Cast ids to string and score to double. With ``order_col``, duplicate
    (qid, docno) rows keep the last row (highest order value); without it
    they are an error. ``by``: further columns that tell runs apart."""
    run = run.select(*by, F.col("qid").cast("string").alias("qid"),
                     F.col("docno").cast("string").alias("docno"),
                     F.col("score").cast("double").alias("score"),
                     *([F.col(order_col)] if order_col else []))
    if order_col:
        run = run.groupBy(*by, "qid", "docno").agg(
            F.max_by("score", order_col).alias("score"))
    else:
        run = _one_row(run, "score", "a run holds a (qid, docno) twice", by)
    return run


def _one_row(df: DataFrame, value: str, message: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with one row per (qid, docno); a second one fails the job."""
    g = df.groupBy(*by, "qid", "docno").agg(F.max(value).alias(value), F.count("*").alias("_n"))
    kind = g.schema[value].dataType
    return g.select(*by, "qid", "docno", F.when(F.col("_n") > 1, F.raise_error(message).cast(kind))
                    .otherwise(F.col(value)).alias(value))


def normalize_qrels(qrels: DataFrame) -> DataFrame:
    return _one_row(qrels.select(F.col("qid").cast("string").alias("qid"),
                                 F.col("docno").cast("string").alias("docno"),
                                 F.col("label").cast("int").alias("label")),
                    "label", "judgments hold a (qid, docno) twice")


def _ideal_dcg(qrels: DataFrame, cutoffs: list[int | None]) -> DataFrame:
    """(qid, idcg_<k>) from label counts; positions of a label block start
    after all higher labels, the block sum of 1/log2(i+1) is split in chunks."""
    counts = (qrels.filter(F.col("label") > 0).groupBy("qid", "label")
              .agg(F.count("*").alias("c")))
    w = (Window.partitionBy("qid").orderBy(F.col("label").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("s", F.coalesce(F.sum("c").over(w), F.lit(0)))
    chunks = counts.select(
        "qid", "label", "s", "c",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / IDEAL_CHUNK)
                             .cast("long"))).alias("chunk"))
    lo = F.col("s") + F.col("chunk") * IDEAL_CHUNK + 1
    hi = F.least(F.col("s") + F.col("c"), lo + IDEAL_CHUNK - 1)
    outs = []
    for k in cutoffs:
        h = hi if k is None else F.least(hi, F.lit(k))
        seg = F.when(h >= lo, F.aggregate(
            F.sequence(lo, h), F.lit(0.0),
            lambda acc, i: acc + F.lit(1.0) / F.log2(i.cast("double") + 1.0))
        ).otherwise(F.lit(0.0))
        outs.append(F.sum(F.col("label").cast("double") * seg).alias(_kname("idcg", k)))
    return chunks.groupBy("qid").agg(*outs)


def _kname(prefix: str, k) -> str:
    return f"{prefix}_{'all' if k is None else k}"


def per_query(run: DataFrame, qrels: DataFrame, metrics, by: tuple[str, ...] = ()) -> DataFrame:
    """Long per-query table (qid, metric, value) for queries present in both
    the run and the judgments. With ``by`` the frame holds several runs, told
    apart by these columns, which come first in the result: all of them share
    one join with the judgments and one grouping."""
    ms = [m if isinstance(m, Metric) else parse_metric(m) for m in metrics]
    by = tuple(by)
    run = normalize_run(run, by=by)
    qrels = normalize_qrels(qrels)
    w = Window.partitionBy(*by, "qid").orderBy(F.col("score").desc(), F.col("docno").asc())
    ranked = run.withColumn("r", F.row_number().over(w))
    judged = ranked.join(qrels, ["qid", "docno"], "left").withColumn(
        "label", F.coalesce(F.col("label"), F.lit(0)))
    rels = sorted({m.rel for m in ms if m.measure in ("ap", "rr", "p", "recall")})
    wr = (Window.partitionBy(*by, "qid").orderBy("r")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for rel in rels:
        judged = judged.withColumn(
            f"cum{rel}", F.sum((F.col("label") >= rel).cast("int")).over(wr))

    r = F.col("r")
    aggs = {}
    for i, m in enumerate(ms):
        in_k = F.lit(True) if m.k is None else (r <= m.k)
        relf = F.col("label") >= m.rel
        if m.measure == "ap":
            aggs[f"_m{i}"] = F.sum(F.when(relf & in_k, F.col(f"cum{m.rel}") / r).otherwise(0.0))
        elif m.measure in ("p", "recall"):
            aggs[f"_m{i}"] = F.sum(F.when(relf & in_k, 1.0).otherwise(0.0))
        elif m.measure == "rr":
            aggs[f"_m{i}"] = F.max(F.when(relf & in_k, 1.0 / r).otherwise(0.0))
        elif m.measure == "ndcg":
            gain = F.greatest(F.col("label"), F.lit(0)).cast("double")
            aggs[f"_m{i}"] = F.sum(F.when(in_k, gain / F.log2(r.cast("double") + 1.0))
                                 .otherwise(0.0))
    sums = judged.groupBy(*by, "qid").agg(*[v.alias(k) for k, v in aggs.items()])

    # judged-side statistics per qid: R per threshold and ideal DCG per cutoff
    qstats = qrels.groupBy("qid").agg(
        *[F.sum((F.col("label") >= rel).cast("double")).alias(f"R{rel}")
          for rel in sorted({m.rel for m in ms})])
    cutoffs = sorted({m.k for m in ms if m.measure == "ndcg"}, key=lambda x: (x is None, x))
    if cutoffs:
        qstats = qstats.join(_ideal_dcg(qrels, cutoffs), "qid", "left")
    both = sums.join(qstats, "qid")  # queries in run ∩ judgments

    vals = []
    for i, m in enumerate(ms):
        x = F.col(f"_m{i}")
        R = F.col(f"R{m.rel}")
        if m.measure in ("ap", "recall"):
            v = F.when(R > 0, x / R).otherwise(0.0)
        elif m.measure == "p":
            v = x / float(m.k) if m.k else x
        elif m.measure == "rr":
            v = x
        else:
            idcg = F.coalesce(F.col(_kname("idcg", m.k)), F.lit(0.0))
            v = F.when(idcg > 0, x / idcg).otherwise(0.0)
        vals.append(F.struct(F.lit(m.name).alias("metric"), v.cast("double").alias("value")))
    return both.select(*by, "qid", F.explode(F.array(*vals)).alias("mv")).select(
        *by, "qid", "mv.metric", "mv.value")


def with_missing_zero(pq: DataFrame, qrels: DataFrame, metrics, topics=None,
                      groups: dict[str, Column] | None = None) -> DataFrame:
    """Add value 0 for judged queries (optionally restricted to ``topics``)
    that have no result at all. ``groups``: for each column that tells runs
    apart, an array of all its values."""
    by = list(groups or {})
    names = [m.name if isinstance(m, Metric) else m for m in metrics]
    judged = normalize_qrels(qrels).select("qid").distinct()
    if topics is not None:
        judged = judged.join(topics.select(F.col("qid").cast("string").alias("qid")),
                             "qid", "left_semi")
    grid = judged.select("qid", F.explode(F.array(*[F.lit(n) for n in names])).alias("metric"))
    for column, values in (groups or {}).items():
        grid = grid.withColumn(column, F.explode(values))
    return grid.join(pq, [*by, "qid", "metric"], "left").select(
        *by, "qid", "metric", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))


def evaluate_run(run: DataFrame, qrels: DataFrame, metrics, missing: str = "drop",
                 topics: DataFrame | None = None) -> DataFrame:
    """Mean of each metric → (metric, value). ``missing='drop'`` averages over
    queries present in run and judgments; ``'zero'`` counts judged queries
    without results as 0. No evaluated query → null."""
    pq = per_query(run, qrels, metrics)
    if missing == "zero":
        pq = with_missing_zero(pq, qrels, metrics, topics)
    return pq.groupBy("metric").agg(F.avg("value").alias("value"))


def experiment(runs: dict[str, DataFrame], qrels: DataFrame, metrics,
               topics: DataFrame | None = None, missing: str = "zero",
               per_query_out: bool = False) -> DataFrame:
    """All systems in one job: the runs, told apart by ``system``, share one
    join with the judgments and one grouping. Returns long (system, metric,
    value) means, or per-query rows."""
    tagged = reduce(DataFrame.unionByName, [
        run.select("qid", "docno", F.col("score").cast("double").alias("score"), F.lit(name).alias("system"))
        for name, run in runs.items()])
    pq = per_query(tagged, qrels, metrics, ("system",))
    if missing == "zero":
        pq = with_missing_zero(pq, qrels, metrics, topics, {"system": F.array(*[F.lit(name) for name in runs])})
    if per_query_out:
        return pq.select("system", "qid", "metric", "value")
    return pq.groupBy("system", "metric").agg(F.avg("value").alias("value"))


# --- significance ---------------------------------------------------------------

def _gamma_ratio(z: Column) -> Column:
    """gamma(z + 1/2) / gamma(z): the series in 1/z, at z moved up by 16."""
    far, ratio = z + 16, F.lit(1.0)
    for i in range(16):
        ratio = ratio * (z + i) / (z + (i + 0.5))
    inverse = 1.0 / far
    series = F.lit(0.0)
    for c in (869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):
        series = series * inverse + c
    return ratio * F.sqrt(far) * series


def student_t_two_sided_p(t: Column, nu: Column) -> Column:
    """Two-sided p-value of Student's t with ν degrees of freedom: with
    x = ν / (ν + t²) the regularised incomplete beta I_x(ν/2, 1/2), in
    ``BETA_STEPS`` steps whatever ν is. Far from 0 by the even part of the
    continued fraction, from its last term; near 0 (t² < 3) as one minus the
    power series of I_1-x(1/2, ν/2), whose terms are all positive."""
    nu, t2 = nu.cast("double"), (t * t).cast("double")
    a, y, x = nu / 2, t2 / (nu + t2), nu / (nu + t2)
    front = F.exp(-a * F.log1p(t2 / nu)) * F.sqrt(y) * _gamma_ratio(a) / math.sqrt(math.pi)
    downwards = F.sequence(F.lit(BETA_STEPS), F.lit(1), F.lit(-1))

    def below(n: Column) -> Column:
        # with two degrees of freedom the first term (n = 0) is 0 / 0, and 0
        return (n + F.coalesce(F.try_divide(n * (0.5 - n) * x, a + 2 * n - 1), F.lit(0.0))
                + (a + n) * (a * y - 0.5 * x + 1 + n * (2 - x)) / (a + 2 * n + 1))

    def above(n: Column) -> Column:
        return (a + n - 1) * (a + n - 0.5) * n * (0.5 - n) * x * x / ((a + 2 * n - 1) * (a + 2 * n - 1))

    fraction = F.aggregate(downwards, below(F.lit(BETA_STEPS + 1.0)),
                           lambda acc, n: below(n - F.lit(1.0)) + above(n.cast("double")) / acc)
    series = F.aggregate(downwards, F.lit(1.0), lambda acc, n: 1.0 + acc * y * (a + n - 0.5) / (n + 0.5))
    return F.when(t2 < 3, 1.0 - 2.0 * front * series).otherwise(front / fraction)


def paired_ttest(per_query_values: DataFrame, baseline: str) -> DataFrame:
    """per_query_values (system, qid, metric, value) → (system, metric, n,
    mean_diff, t, p) for every non-baseline system vs ``baseline``, over
    queries both systems have. sd = 0 → t and p null."""
    base = per_query_values.filter(F.col("system") == baseline).select(
        "qid", "metric", F.col("value").alias("b"))
    other = per_query_values.filter(F.col("system") != baseline)
    d = other.join(base, ["qid", "metric"]).withColumn("d", F.col("value") - F.col("b"))
    g = d.groupBy("system", "metric").agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_diff"),
        F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n"))))
    g = g.withColumn("t", t)
    return g.withColumn("p", F.when(F.col("t").isNotNull() & (F.col("n") > 1),
                                    student_t_two_sided_p(F.col("t"), F.col("n") - 1))
                        ).drop("sd")


def bonferroni(p: Column, m) -> Column:
    return F.least(F.lit(1.0), p * m)


def compare_table(metrics_long: DataFrame, systems: list[str]) -> DataFrame:
    """metric × system pivot (explicit system list: no extra pass to find the
    pivot values)."""
    return metrics_long.groupBy("metric").pivot("system", systems).agg(F.first("value"))


def improvement_pct(value: Column, base: Column) -> Column:
    """((x - b) / b · 100) rounded to 2 places; null when b = 0."""
    return F.when(base != 0, F.round((value - base) / base * 100.0, 2))


def best_method(metrics_long: DataFrame, system_order: list[str]) -> DataFrame:
    """Per metric the system with the highest value; ties → the earlier system
    in ``system_order``. Means equal to 9 places are ties: their last places
    hang on the order of summation."""
    order = F.array_position(F.array(*[F.lit(s) for s in system_order]), F.col("system"))
    w = Window.partitionBy("metric").orderBy(F.round("value", 9).desc(), order.asc())
    return (metrics_long.withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").select("metric", F.col("system").alias("best_system"),
                                      "value"))


def subset_topics(run: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of a run whose qid is in the supplied topics (semi join)."""
    return run.join(bounded_broadcast(topics.select(F.col("qid").cast("string").alias("qid"))),
                    "qid", "left_semi")
