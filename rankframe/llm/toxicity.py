"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

*Folding.* Case, accents, homoglyphs (Cyrillic, Greek, full-width, ...) and
digits written for letters are folded to plain letters, invisible characters
are removed, everything else becomes a space. ``i``, ``l`` and ``1`` look
alike and share one letter.

*Lexicon.* Whole words, and word beginnings (``PREFIXES`` letters) that gather
several words, whose share of the words of toxic training texts is above that
in the others, weighted by the log of the ratio of the mean shares. A pattern
must stand apart by several standard errors (``STRONG``) and, as copies of one text must
not make its words look toxic, follow several different words. Of nested
patterns the one that stands apart most stays; their number isn't limited but
by the training rows. ``SEEDS`` are insults known beforehand; they get a
default weight unless the labels speak against them.

*Exceptions.* A hit inside an exception phrase does not count.

*Score.* Three measures go through a logistic curve fitted on the training
rows: the weights of the hits, the same normalised by the length in words, and
the weights beyond those that as many words of clean text hold, all on a
logarithmic scale.

The lexicon and the curve are fitted on at most ``TRAIN_ROWS`` labelled rows
(those with the smallest id hashes); every text is scored as a whole.

Defined cases: null and empty texts have no hit; rows without a label are
not learned from; a document with several labels counts as toxic if any of
its labels is, and so do equal texts if one of them does; without any toxic training row only the seeds count; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# --- fixed values ---------------------------------------------------------------
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
MIN_DOCS, MIN_CONTEXTS, CONTEXT_SHARE = 3, 4, 1 / 3   # different words before a pattern: least, and of its texts
STRONG = ((4.0, 1.2), (1.7, 3.5))   # least standard errors apart, and weight: one pair suffices
PREFIX_GAIN = 1.1   # how much further apart a word beginning must stand than its best word
SHORT = 20          # words added to a text's length, so that a short text's shares stay small
SEED_WEIGHT, MAX_WEIGHT = 3.0, 6.0
BALANCE = 0.5       # 0: the labels' own shares, 1: both labels weigh the same
DIGITS = dict(zip("0134578", "oieastb", strict=True))
HOMOGLYPHS = {
    # Cyrillic
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "һ": "h", "ӏ": "i", "ь": "b",
    # Greek
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    # Armenian, Latin look-alikes
    "ո": "n", "ս": "u", "օ": "o", "ց": "g", "ɡ": "g", "ı": "i", "ɑ": "a", "ø": "o", "ł": "i", "đ": "d",
}
SEEDS = ("idiot idiots moron morons imbecile imbeciles cretin stupid loser losers scum scumbag scumbags "
         "worthless pathetic disgusting vermin dimwit dumbass jackass bastard bastards asshole assholes "
         "bitch bitches shithead").split()
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "trash collection", "pond scum",
              "soap scum", "clown fish", "circus clown", "rodeo clown", "sore loser", "stupid question",
              "stupid questions", "keep it simple stupid", "vermin control", "idiot proof")
# --- end of fixed values ----------------------------------------------------------

_SAME = {"l": "i"}
_INSIDE = re.compile(r"(?<=\w)[@$]+(?=\w)")


class Folding(dict):
    """Code point → folded characters; filled as characters are met."""

    def __missing__(self, point: int):
        ch = chr(point)
        low = ch.lower()
        if low in HOMOGLYPHS:
            out = HOMOGLYPHS[low]
        elif ch in DIGITS:
            out = DIGITS[ch]
        elif unicodedata.category(ch) in ("Mn", "Cf"):
            out = None  # combining marks and invisible characters
        else:
            base = [c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)]
            out = "".join(HOMOGLYPHS.get(c, DIGITS.get(c, c)) if c.isalnum() else " " for c in base) or " "
        if out:
            out = "".join(_SAME.get(c, c) for c in out)
        self[point] = out
        return out


def _fold_inside(m: re.Match) -> str:
    return m[0].replace("@", "a").replace("$", "s")


def fold(text: str | None, table: Folding) -> str:
    """Folded words between single or several spaces, with one at each end."""
    if not text:
        return " "
    if "@" in text or "$" in text:
        text = _INSIDE.sub(_fold_inside, text)
    return f" {text.translate(table)} "


@dataclass(frozen=True)
class Lexicon:
    """entries: pattern → weight, patterns folded, with a leading space, and a
    trailing one when a whole word is meant; clean: the weights that a word of
    clean text holds on average; the curve's coefficients."""
    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    clean: float
    curve: tuple[float, ...]


def automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for pattern, weight in entries:
        a.add_word(pattern, (len(pattern), weight))
    for pattern in exceptions:
        a.add_word(pattern, (len(pattern), None))
    if len(a):
        a.make_automaton()
    return a


def weigh(folded: str, machine) -> float:
    """Sum of the weights of the hits outside exception phrases."""
    if not len(machine):
        return 0.0
    hits, covers = [], []
    for end, (size, weight) in machine.iter(folded):
        (covers if weight is None else hits).append((end - size + 1, end, weight))
    if covers:
        # one pass by start: a hit is covered if a phrase that starts no later ends no earlier
        covers.sort()
        hits.sort()
        kept, at, reach = [], 0, -1
        for hit in hits:
            while at < len(covers) and covers[at][0] <= hit[0]:
                reach = max(reach, covers[at][1])
                at += 1
            if hit[1] > reach:
                kept.append(hit)
        hits = kept
    return sum(h[2] for h in hits)


def features(texts, entries, exceptions, clean: float) -> np.ndarray:
    """Logarithms of the weight, the weight in 100 words, and the weight above
    that of clean text."""
    machine, table = automaton(entries, exceptions), Folding()
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        folded = fold(t, table)
        if w := weigh(folded, machine):
            words = len(folded.split())
            above = w - clean * words
            out[i] = math.log1p(w), math.log1p(100 * w / (words + SHORT)), math.copysign(math.log1p(abs(above)), above)
    return out


# ------------------------------------------------------------------- learning
def sample(df: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about ``rows`` rows, those with the smallest id hashes."""
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * (1 << 32))
    return df.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 32) < cut)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learned: "F.Column",
                  rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of the labelled documents that may be learned from."""
    y = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(learned)
         .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    # at most TRAIN_ROWS short rows: broadcast, so that no text is shuffled
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .join(F.broadcast(sample(y, rows)), "doc_id")


def _patterns(words: list[str]) -> Counter:
    """How often each word, and each beginning of a longer word, occurs."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[f" {w} "] += n
        for k in PREFIXES:
            if len(w) > k:
                out[" " + w[:k]] += n
    return out


_COUNTED = "pattern string, y int, docs long, share double, square double"


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per pattern and label: documents, and the sums of their shares (in 100
    words) and of the shares' squares."""
    table = Folding()
    for batch in batches:
        sums: dict = {}
        for text, y in zip(batch["text"], batch["y"], strict=True):
            words = fold(text, table).split()
            for pattern, n in _patterns(words).items():
                share = 100 * n / (len(words) + SHORT)
                entry = sums.setdefault((pattern, int(y)), [0, 0.0, 0.0])
                entry[0] += 1
                entry[1] += share
                entry[2] += share * share
        if sums:
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=[c.split()[0] for c in _COUNTED.split(", ")])


def _context_counter(wanted: frozenset[str]):
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Folding()
        for batch in batches:
            found = set()
            for text in batch["text"]:
                before = ""
                for w in fold(text, table).split():
                    for p in (f" {w} ", *(" " + w[:n] for n in PREFIXES if len(w) > n)):
                        if p in wanted:
                            found.add((p, before))
                    before = w
            if found:
                yield pd.DataFrame(list(found), columns=["pattern", "before"])
    return contexts


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps. The rarer label's rows weigh more
    by the BALANCE-th power of the ratio of both."""
    a = np.column_stack([np.ones(len(x)), x])
    c = np.array([-2.0, 0.5, 0.5, 0.0])
    if not len(y) or y.min() == y.max():
        return tuple(c)
    penalty = ridge * len(y) / 100 * np.diag([0.0, 1.0, 1.0, 1.0])
    c, weight = np.zeros(4), np.where(y > 0, (len(y) / y.sum() - 1) ** BALANCE, 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-6 * np.eye(4)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - penalty @ c)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in c)


def measured_patterns(train: DataFrame, toxic: int, other: int) -> DataFrame:
    """(pattern, p, n, w, t): documents of both labels with it, the log ratio
    of its mean shares, and how many standard errors these stand apart."""
    counts = train.mapInPandas(_document_counts, _COUNTED)

    def of(name: str, y: int) -> "F.Column":
        return F.sum(F.when(F.col("y") == y, F.col(name)).otherwise(0))
    g = counts.groupBy("pattern").agg(*[of(name, y).alias(f"{name}{y}") for name in ("docs", "share", "square") for y in (1, 0)])
    m1, m0 = F.col("share1") / toxic, F.col("share0") / other
    v1 = F.greatest(F.col("square1") / toxic - m1 * m1, F.lit(0.0)) / toxic
    v0 = F.greatest(F.col("square0") / other - m0 * m0, F.lit(0.0)) / other
    least = 50.0 / (100 + SHORT)   # half a hit in a text of 100 words
    return g.select("pattern", F.col("docs1").alias("p"), F.col("docs0").alias("n"),
                    F.log((m1 + least / toxic) / (m0 + least / other)).alias("w"),
                    ((m1 - m0) / F.sqrt(v1 + v0 + least * least / toxic / toxic)).alias("t"), m0.alias("clean"))


def chosen(rows: list, contexts: dict[str, int]) -> dict[str, float]:
    """pattern → weight of the patterns that stay, none of which begins another."""
    rows = [r for r in rows if contexts.get(r["pattern"], 0) >= max(MIN_CONTEXTS, CONTEXT_SHARE * r["p"])]
    best = {r["pattern"]: r["t"] for r in rows}
    word: dict[str, float] = {}
    for pattern, t in best.items():
        for k in PREFIXES:
            if pattern.endswith(" ") and len(pattern) > k + 2:
                word[pattern[:k + 1]] = max(word.get(pattern[:k + 1], 0.0), t)
    entries: dict[str, float] = {}
    under: set[str] = set()  # beginnings of the entries
    for r in sorted(rows, key=lambda r: (-r["t"], r["pattern"])):
        pattern = r["pattern"]
        if not pattern.endswith(" ") and r["t"] < PREFIX_GAIN * word.get(pattern, 0.0):
            continue  # one word makes up this beginning: take the word
        if pattern in under or any(pattern[:k + 1] in entries for k in PREFIXES):
            continue
        entries[pattern] = round(min(r["w"], MAX_WEIGHT), 4)
        under.update(pattern[:k + 1] for k in PREFIXES)
    return entries


def learn(train: DataFrame) -> Lexicon:
    """The lexicon and curve of (doc_id, text, y) rows, which are bounded."""
    train = train.groupBy("text").agg(F.max("y").alias("y")).persist()
    try:
        totals = dict(train.groupBy("y").count().collect())
        p_all, n_all = totals.get(1, 0), totals.get(0, 0)
        counts = measured_patterns(train, max(p_all, 1), max(n_all, 1))
        table = Folding()
        seeds = [fold(s, table) for s in SEEDS]
        apart = [(F.col("t") >= t) & (F.col("w") >= w) for t, w in STRONG]
        known = (F.col("p") >= MIN_DOCS) & reduce(or_, apart)
        rows = (counts.withColumn("strong", known).filter(F.col("strong") | F.col("pattern").isin(seeds))
                .collect())  # of the bounded training rows
        strong = [r for r in rows if r["strong"]]
        names = frozenset(r["pattern"] for r in strong)
        contexts = dict(train.filter("y = 1").mapInPandas(_context_counter(names), "pattern string, before string")
                        .distinct().groupBy("pattern").count().collect()) if names else {}
        entries = chosen(strong, contexts)
        against = {r["pattern"] for r in rows if r["n"] > 3 * r["p"]}
        for s in seeds:
            if s not in against and s not in entries and not any(s.rstrip()[:k + 1] in entries for k in PREFIXES):
                entries[s] = SEED_WEIGHT
        share = {r["pattern"]: r["clean"] for r in rows}
        clean = sum(w * share.get(pattern, 0.0) for pattern, w in entries.items()) / 100
        lexicon = tuple(sorted(entries.items()))
        exceptions = tuple(sorted(fold(e, table) for e in EXCEPTIONS))

        @pandas_udf("array<double>")
        def measured(texts: pd.Series) -> pd.Series:
            return pd.Series(features(texts, lexicon, exceptions, clean).tolist())
        measures = train.select(measured("text").alias("x"), "y").collect()  # bounded by TRAIN_ROWS
    finally:
        train.unpersist()
    x = np.array([r["x"] for r in measures]).reshape(-1, 3)
    return Lexicon(lexicon, exceptions, clean, _curve(x, np.array([r["y"] for r in measures], dtype=float)))


def scorer(lexicon: Lexicon):
    """Column function text → score (0 to 1)."""
    first, *curve = lexicon.curve

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = features(texts, lexicon.entries, lexicon.exceptions, lexicon.clean)
        return pd.Series(1 / (1 + np.exp(-np.clip(first + x @ np.array(curve), -30, 30))))
    return score


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    return (docs.withColumn("score", scorer(lexicon)("text"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def reject(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without those predicted toxic."""
    return docs.filter(scorer(lexicon)(F.col("text")) < THRESHOLD)
