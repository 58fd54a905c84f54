"""Benchmark decontamination with a BM25 index and block-max WAND.

The test items form an inverted index: per term the items that hold it with
their BM25 impact, divided by the item's score against itself, so a passage
that holds all of an item scores 1 and one threshold fits all items. Items
are cut into blocks; each term keeps its largest impact per block.

Every training text is cut into passages of ``2 * stride`` words that overlap
by half, where a stride is at least as long as the longest item of the index
part, so a leaked item lies whole in some passage. A passage is a query of its
distinct words. Running sums of the terms' largest impacts rule out passages
that can't reach the threshold in any item; of the others, the blocks whose
summed maxima reach the threshold are the pivots, all other blocks are
skipped, and the pivots' items are scored in full: all items at or above the
threshold are found.

Candidates are verified on the text: the words of the item's question and of
its answer are looked up as shingles of ``SHINGLE`` words; both parts must be
found to a share of at least ``OVERLAP``. An item without an answer (null, or no
such column) is one part, all of its text: no sentence of it decides alone.

The index goes to the tasks in parts of at most ``PART_ITEMS`` items and
``PART_WORDS`` words, grouped by length: its broadcast size is bounded and any
number of items works, at one pass over the texts per part. Documents are
handled row by row; nothing is shuffled.

Defined cases: null and empty texts have no passage; items without a word
match nothing; an item whose question or answer is shorter than a shingle
needs all its words in order; an item without an id is searched like any other
and reported with a null id; repeated items are reported each; repeated rows
are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# --- fixed values ---------------------------------------------------------------
K1, B = 1.2, 0.75
THRESHOLD = 0.6         # of the item's score against itself
SHINGLE, OVERLAP = 5, 0.8
BLOCK = 8               # items in a block
PART_ITEMS, PART_WORDS = 4096, 400_000
MIN_STRIDE = 32
# --- end of fixed values ----------------------------------------------------------

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Item:
    item_id: int | None
    question: tuple[str, ...]
    answer: tuple[str, ...]

    @property
    def words(self) -> tuple[str, ...]:
        return self.question + self.answer


def split_item(item_id: int | None, text: str | None, answer: str | None = None) -> Item:
    """An item in words; without an answer its whole text is the question."""
    return Item(item_id, tuple(words_of(text)), tuple(words_of(answer)))


class Index:
    """Inverted index of some items, with block maxima."""

    def __init__(self, items: list[Item], threshold: float = THRESHOLD):
        self.items, self.threshold = items, threshold
        self.stride = max([MIN_STRIDE, *(len(i.words) for i in items)])
        n, df = len(items), Counter(t for i in items for t in set(i.words))
        mean = sum(len(i.words) for i in items) / max(n, 1)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        n_terms, self.blocks = len(self.terms), (n + BLOCK - 1) // BLOCK
        held: dict[tuple[int, int], np.ndarray] = {}
        for at, item in enumerate(items):
            tf = Counter(item.words)
            long = K1 * (1 - B + B * len(item.words) / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + long)
                      for t, f in tf.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                held.setdefault((self.terms[t], at // BLOCK), np.zeros(BLOCK))[at % BLOCK] = x / own
        # postings by term, then block: an entry has the impacts of the block's items and their maximum
        keys = sorted(held)
        self.impacts = np.array([held[k] for k in keys]).reshape(-1, BLOCK)
        self.block_of = np.array([b for _, b in keys], dtype=np.int64)
        self.block_max = self.impacts.max(axis=1, initial=0.0)
        of_term = np.array([t for t, _ in keys], dtype=np.int64)
        self.first = np.searchsorted(of_term, np.arange(n_terms + 1))
        self.most = np.zeros(n_terms + 1)  # largest impact per term; last entry: words outside the index
        np.maximum.at(self.most, of_term, self.block_max)

    def codes(self, words: list[str]) -> np.ndarray:
        get, none = self.terms.get, len(self.terms)
        return np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))

    def passages(self, codes: np.ndarray) -> np.ndarray:
        """Starts of the passages whose upper bound reaches the threshold. The
        bound counts a repeated word once per occurrence, so it never falls
        below the passage's true bound."""
        s = self.stride
        starts = np.arange(0, max(1, len(codes) - s), s)
        sums = np.concatenate([[0.0], np.cumsum(self.most[codes])])
        upper = sums[np.minimum(starts + 2 * s, len(codes))] - sums[starts]
        return starts[upper >= self.threshold - 1e-9]

    def candidates(self, terms: np.ndarray) -> dict[int, float]:
        """All items whose score against the distinct ``terms`` reaches the
        threshold: the pivots are the blocks whose summed maxima reach it, all
        others are skipped; a pivot's items are scored in full."""
        limit = self.threshold - 1e-9
        sizes = self.first[terms + 1] - self.first[terms]
        entries = np.repeat(self.first[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        blocks = self.block_of[entries]
        bound = np.bincount(blocks, weights=self.block_max[entries], minlength=self.blocks)
        found: dict[int, float] = {}
        for pivot in np.flatnonzero(bound >= limit):
            scores = self.impacts[entries[blocks == pivot]].sum(axis=0)
            for at in np.flatnonzero(scores >= limit):
                found[int(pivot * BLOCK + at)] = float(scores[at])
        return found

    def search(self, words: list[str]) -> dict[int, float]:
        """Best score of each item at or above the threshold in any passage."""
        codes, best, none = self.codes(words), {}, len(self.terms)
        if not len(codes) or not none:
            return best
        for start in self.passages(codes):
            terms = np.unique(codes[start:start + 2 * self.stride])
            terms = terms[terms < none]
            if self.most[terms].sum() < self.threshold - 1e-9:
                continue
            for item, score in self.candidates(terms).items():
                best[item] = max(best.get(item, 0.0), score)
        return best


def shingle_set(words, n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def overlap(part: tuple[str, ...], found: dict[int, set], words: list[str]) -> float:
    """Share of the part's shingles that the text holds (a short part: one
    shingle of all its words; no part: 1)."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    if n not in found:
        found[n] = shingle_set(words, n)
    own = shingle_set(part, n)
    return len(own & found[n]) / len(own)


def leaks_in(text: str | None, index: Index) -> list[tuple[int, float, float, float]]:
    """(item_id, score, question overlap, answer overlap) of verified leaks."""
    words = words_of(text)
    best = index.search(words)
    if not best:
        return []
    found: dict[int, set] = {}
    out = []
    for at, score in sorted(best.items()):
        item = index.items[at]
        q, a = overlap(item.question, found, words), overlap(item.answer, found, words)
        if q >= OVERLAP and a >= OVERLAP:
            out.append((item.item_id, score, q, a))
    return out


def parts(items: list[Item]) -> list[list[Item]]:
    """Items by length in parts of bounded size; an item's length is at most
    twice that of the part's shortest, beyond MIN_STRIDE."""
    out: list[list[Item]] = []
    total = shortest = 0
    for item in sorted((i for i in items if i.words), key=lambda i: (len(i.words), i.item_id is None, i.item_id or 0)):
        n = len(item.words)
        if (not out or len(out[-1]) >= PART_ITEMS or total + n > PART_WORDS
                or n > 2 * max(shortest, MIN_STRIDE)):
            out.append([])
            total, shortest = 0, n
        out[-1].append(item)
        total += n
    return out


def indexes(items: DataFrame, threshold: float = THRESHOLD) -> list[Index]:
    """Index parts of the test items (item_id, text[, answer]). Test sets are
    read to the driver item by item; the corpus never is."""
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select("item_id", "text", answer.alias("answer")).toLocalIterator()
    return [Index(p, threshold) for p in parts([split_item(r["item_id"], r["text"], r["answer"]) for r in rows])]


def finder(index: Index):
    """Column function text → array of leaks."""
    @pandas_udf("array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True))
                           for x in leaks_in(t, index)] for t in texts])
    return leaks


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every
    document that holds an item."""
    found = docs.select("doc_id", F.lit(None).cast(
        "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>").alias("l")).limit(0)
    for index in indexes(items, threshold):
        found = found.unionByName(docs.select("doc_id", finder(index)("text").alias("l")))
    # outer: else the planner adds a filter that runs the search a second time
    return found.select("doc_id", F.inline_outer("l")).filter(F.col("score").isNotNull())


def remove_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a test item."""
    for index in indexes(items, threshold):
        docs = docs.filter(F.size(finder(index)(F.col("text"))) == 0)
    return docs
