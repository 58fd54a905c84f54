"""Weighting models as Column expressions.

Each model returns the contribution of one matched (query term, document)
posting given columns ``tf, dl, df, cf, qtf`` and the collection statistics
(plain Python numbers, folded into literals by Catalyst). The document score
is the sum of contributions; DirichletLM adds one per-document term.
All arithmetic is DOUBLE.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: model parameters ------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
DIRICHLET_MU = 2500.0
PL2_C = 1.0
LOG2_E = 1.0 / math.log(2.0)
# --- end of fixed values --------------------------------------------------------


def _d(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("double")


def _log2(x: Column) -> Column:
    return F.log2(x)


def bm25(tf, dl, df, cf, qtf, stats, k1=BM25_K1, b=BM25_B) -> Column:
    N = float(stats["num_docs"])
    avgdl = float(stats["avg_dl"]) or 1.0
    tf, dl, df, qtf = _d(tf), _d(dl), _d(df), _d(qtf)
    idf = F.log(F.lit(1.0) + (F.lit(N) - df + 0.5) / (df + 0.5))
    norm = tf * (k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / F.lit(avgdl)))
    return qtf * idf * norm


def tf_idf(tf, dl, df, cf, qtf, stats, k1=BM25_K1, b=BM25_B) -> Column:
    N = float(stats["num_docs"])
    avgdl = float(stats["avg_dl"]) or 1.0
    tf, dl, df, qtf = _d(tf), _d(dl), _d(df), _d(qtf)
    tfw = F.lit(k1) * tf / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / F.lit(avgdl)))
    idf = _log2(F.lit(N) / df + 1.0)
    return qtf * tfw * idf


def dirichlet(tf, dl, df, cf, qtf, stats, mu=DIRICHLET_MU) -> Column:
    """Per-term part; add :func:`dirichlet_doc` once per (query, document)."""
    C = float(stats["num_tokens"])
    tf, cf, qtf = _d(tf), _d(cf), _d(qtf)
    return qtf * F.log(F.lit(1.0) + tf / (F.lit(mu) * cf / F.lit(C)))


def dirichlet_doc(qlen, dl, mu=DIRICHLET_MU) -> Column:
    """Q · ln(μ / (dl + μ)), Q = total query-term weight."""
    return _d(qlen) * F.log(F.lit(mu) / (_d(dl) + F.lit(mu)))


def pl2(tf, dl, df, cf, qtf, stats, c=PL2_C) -> Column:
    N = float(stats["num_docs"])
    avgdl = float(stats["avg_dl"])
    tf, dl, cf, qtf = _d(tf), _d(dl), _d(cf), _d(qtf)
    tfn = tf * _log2(F.lit(1.0) + F.lit(c * avgdl) / dl)
    lam = cf / F.lit(N)
    body = (tfn * _log2(tfn / lam) + (lam - tfn) * F.lit(LOG2_E)
            + F.lit(0.5) * _log2(F.lit(2.0 * math.pi) * tfn))
    return qtf / (tfn + 1.0) * body


def dph(tf, dl, df, cf, qtf, stats) -> Column:
    N = float(stats["num_docs"])
    avgdl = float(stats["avg_dl"])
    tf, dl, cf, qtf = _d(tf), _d(dl), _d(cf), _d(qtf)
    f = tf / dl
    norm = (F.lit(1.0) - f) * (F.lit(1.0) - f) / (tf + 1.0)
    body = (tf * _log2(tf * F.lit(avgdl) / dl * F.lit(N) / cf)
            + F.lit(0.5) * _log2(F.lit(2.0 * math.pi) * tf * (F.lit(1.0) - f)))
    return F.when(f >= 1.0, F.lit(0.0)).otherwise(qtf * norm * body)


MODELS = {
    "BM25": bm25,
    "TF_IDF": tf_idf,
    "DirichletLM": dirichlet,
    "PL2": pl2,
    "DPH": dph,
}


def model_fn(name: str):
    try:
        return MODELS[name]
    except KeyError:
        raise ValueError(f"unknown weighting model {name!r}; have {sorted(MODELS)}")
