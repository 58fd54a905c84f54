"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows marked good; the unlabelled set is the
other web text, drawn from the same training rows with the label hidden. With
class prior p, the risk of a scorer g is

    p R(P, +1) + max(0, R(U, -1) - p R(P, -1))

(Kiryo et al. 2017): where the second part falls below zero on a batch, the
step goes against it, so the network can't push unlabelled positives down.

The prior is estimated, not counted from labels: a first classifier separates
P from U on one half of the rows; on the other half the prior is the smallest
ratio of shares above a threshold, U's share over P's share (both with a
confidence margin), since above a high threshold U holds positives only.

Texts enter as shape statistics of the whole text (character classes, word
lengths, repetition, line forms, ...), so any language and any length is
scored alike. The model is fitted on at most ``TRAIN_ROWS`` labelled rows
(those with the smallest id hashes).

Defined cases: null and empty texts have the statistics of an empty text;
rows without a label are never positives; without any positive row every
text scores the default prior; a document with several labels is good only if
all are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# --- fixed values ---------------------------------------------------------------
TRAIN_ROWS = 30_000
THRESHOLD = 0.7
DEFAULT_PRIOR = 0.5
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 60, 512, 0.01, 1e-4, 7
MARGIN = 1.0            # standard errors of the confidence margin of the prior
LEAST_TOP = 0.1         # share of P above a threshold from which ratios count
# --- end of fixed values ----------------------------------------------------------

_KINDS = np.zeros(256, dtype=np.int64)  # letter, upper, digit, space, line, then single marks, other
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (0 if _b >= 128 or _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit()
                  else 4 if _c == "\n" else 3 if _c in " \t\r\x0b\x0c" else 5)
_MARKS = b".,;:!?'\"()[]{}<>|/\\#$%&*@+-=_~^"
_FIXED = 24
N_FEATURES = _FIXED + len(_MARKS)


def statistics(text: str | None) -> np.ndarray:
    """The shape statistics of a whole text."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    kinds = np.bincount(_KINDS, weights=by, minlength=6) / n
    words = raw.split()
    w = max(1, len(words))
    lines = raw.split(b"\n")
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    ends = Counter(x[-1:] for x in words)
    heads = Counter(x[:1].isupper() for x in words)
    marks = by[np.frombuffer(_MARKS, dtype=np.uint8)]
    p = by[by > 0] / n
    repeated = sum(map(eq, words, words[1:]))
    twice = sum(map(eq, words, words[2:]))
    line_copies = 1 - len(set(lines)) / len(lines)
    alone = sum(1 for x in words if len(x) == 1 and not x.isalnum())
    capital = sum(1 for x in words if len(x) > 1 and x.isupper())
    noisy = sum(1 for x in words if len(x) > 2 and x[-3:].strip(b"!#$%&*@~^=+_|") == b"")
    shout = sum(1 for x in words if x[-2:] == b"!!")
    odd = sum(ends[m] for m in (b"!", b"#", b"$", b"%", b"&", b"*", b"@", b"~", b"|"))
    out[:_FIXED] = (
        *kinds, np.log1p(w) / 10, np.log1p(n) / 12, lengths.mean() / 10, lengths.std() / 10,
        min(lengths.max(), 200) / 50, len(seen) / w, len(seen) / w ** 0.8, top / w, repeated / w, twice / w,
        line_copies, -(p * np.log(p)).sum() / 4, alone / w, capital / w, noisy / w, shout / w, odd / w,
        heads[True] / w)
    out[_FIXED:] = np.sqrt(marks / w)
    return out


def statistics_of(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, N_FEATURES)


# ------------------------------------------------------------------- learning
@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.layers
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _train(pos: np.ndarray, unl: np.ndarray, gradient, epochs: int, seed: int) -> tuple[np.ndarray, ...]:
    """Adam over mini-batches; ``gradient(logits of P, of U)`` gives the
    derivatives of the risk by the logits."""
    rng = np.random.default_rng(seed)
    d = pos.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    steps, t = max(1, len(unl) // BATCH), 0
    for epoch in range(epochs):
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        p_order, u_order = rng.permutation(len(pos)), rng.permutation(len(unl))
        for i in range(steps):
            p = pos[np.take(p_order, np.arange(i * BATCH, (i + 1) * BATCH), mode="wrap")]
            u = unl[np.take(u_order, np.arange(i * BATCH, (i + 1) * BATCH), mode="wrap")]
            x = np.vstack([p, u])
            h = np.tanh(x @ layers[0] + layers[1])
            g = h @ layers[2] + layers[3][0]
            dg = gradient(g[:len(p)], g[len(p):])
            dh = np.outer(dg, layers[2]) * (1 - h * h)
            grads = [x.T @ dh + DECAY * layers[0], dh.sum(axis=0), h.T @ dg + DECAY * layers[2],
                     np.array([dg.sum()])]
            t += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                layers[k] = layers[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(layers)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def non_negative_gradient(prior: float):
    """Derivative of the non-negative risk with logistic loss."""
    def gradient(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(gp), _sigmoid(gu)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_positive = prior * (sp - 1) / len(gp)
        from_u, from_p = su / len(gu), -prior * sp / len(gp)
        if rest >= 0:
            return np.concatenate([as_positive + from_p, from_u])
        return np.concatenate([-from_p, -from_u])  # step against the negative part
    return gradient


def _separate(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
    """Derivative of the plain logistic loss of P against U."""
    return np.concatenate([(_sigmoid(gp) - 1) / len(gp), _sigmoid(gu) / len(gu)]) / 2


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = SEED) -> float:
    """Share of positives in ``unl`` from a P-against-U classifier."""
    if len(pos) < 20 or len(unl) < 20:
        return DEFAULT_PRIOR
    cut_p, cut_u = len(pos) // 2, len(unl) // 2
    layers = _train(pos[:cut_p], unl[:cut_u], _separate, EPOCHS // 2, seed)
    zero, one = np.zeros(pos.shape[1]), np.ones(pos.shape[1])
    g = Model(zero, one, layers, DEFAULT_PRIOR)
    gp, gu = np.sort(g.logits(pos[cut_p:])), np.sort(g.logits(unl[cut_u:]))
    at = np.concatenate([gp, gu])
    top_p = 1 - np.searchsorted(gp, at) / len(gp)
    top_u = 1 - np.searchsorted(gu, at) / len(gu)
    margin = MARGIN * (np.sqrt(top_p * (1 - top_p) / len(gp)) + np.sqrt(top_u * (1 - top_u) / len(gu)))
    ok = top_p >= LEAST_TOP
    upper = (top_u + margin)[ok] / top_p[ok]
    return float(np.clip((top_u[ok] / top_p[ok])[np.argmin(upper)], 0.01, 0.99))


def fit(x: np.ndarray, trusted: np.ndarray, prior: float | None = None, seed: int = SEED) -> Model:
    """``x``: statistics of training rows; ``trusted``: which are known positives."""
    d = x.shape[1] if x.ndim == 2 else N_FEATURES
    if not trusted.any():
        return Model(np.zeros(d), np.ones(d), (), DEFAULT_PRIOR)
    order = np.random.default_rng(seed).permutation(len(x))
    x, trusted = x[order], trusted[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    prior = estimate_prior(z[trusted], z, seed) if prior is None else prior
    epochs = max(EPOCHS, min(600, EPOCHS * 4000 // max(1, len(x))))
    return Model(mean, scale, _train(z[trusted], z, non_negative_gradient(prior), epochs, seed), prior)


def learn(train: DataFrame) -> Model:
    """The model of (doc_id, text, y) rows, which are bounded; y = 1 marks the
    trusted positives, all rows with their label hidden are the unlabelled."""
    @pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics_of(texts)))
    rows = train.select("doc_id", measured("text").alias("x"), "y").collect()  # bounded by TRAIN_ROWS
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    return fit(x, np.array([r["y"] == 1 for r in rows], dtype=bool))


def scorer(model: Model):
    """Column function text → score (0 to 1)."""
    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics_of(texts)))
    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    return (docs.withColumn("score", scorer(model)("text"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
