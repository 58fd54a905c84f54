"""Per-session cache of the test collection built from one scale-factor
folder: corpus, topics, judgments and the index are built once and reused by
every registered query (the index tables are persisted)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import RAW, STOP_ONLY, Analyzer
from ..operators.index import Index, build_index
from ..session import ensure_checkpoint_dir
from ..sources import collection as col

# Analyzer of the registered queries: the SQL oracle has no stemmer offline,
# so the driver queries index with stopwords and no stemming; the Porter path
# is covered by tests and the `porter_stem` / `bm25_porter` keys.
QUERY_ANALYZER = STOP_ONLY

_CACHE: dict = {}


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._index: dict[Analyzer, Index] = {}
        self._memo: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        return col.table(self.spark, self.sf_dir, name)

    @property
    def corpus(self) -> DataFrame:
        return self.memo("corpus", lambda: col.corpus(self.spark, self.sf_dir))

    @property
    def topics(self) -> DataFrame:
        return self.memo("topics", lambda: col.topics(self.spark, self.sf_dir))

    def index(self, analyzer: Analyzer = QUERY_ANALYZER, positions: bool = False) -> Index:
        key = (analyzer, positions)
        if key not in self._index:
            self._index[key] = build_index(self.corpus, analyzer, positions=positions)
        return self._index[key]

    def stored_index(self) -> Index:
        """The index with positions, written below the shared folder (once a
        session, so that it never outlives its tables) and reopened."""
        if "stored" not in self._memo:
            name = hashlib.md5(self.sf_dir.encode()).hexdigest()
            path = os.path.join(ensure_checkpoint_dir(self.spark), "rankframe-index",
                                f"{self.spark.sparkContext.applicationId}-{name}")
            self._memo["stored"] = Index.open_or_build(self.corpus, path, QUERY_ANALYZER, buckets=64, positions=True)
        return self._memo["stored"]

    def qterms(self, analyzer: Analyzer = QUERY_ANALYZER):
        """Size-checked, persisted query-term table of the topics."""
        from ..operators.retrieve import QueryTerms, query_terms
        key = ("qterms", analyzer)
        if key not in self._memo:
            self._memo[key] = QueryTerms(query_terms(self.topics, analyzer))
        return self._memo[key]

    @property
    def qrels(self) -> DataFrame:
        def build():
            q = col.containment_qrels(self.corpus, self.topics, None,
                                      col.labels(self.spark, self.sf_dir))
            return q.persist()
        return self.memo("qrels", build)

    def memo(self, key: str, fn) -> DataFrame:
        if key not in self._memo:
            self._memo[key] = fn()
        return self._memo[key]


def ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Ctx(spark, sf_dir)
    return _CACHE[key]


__all__ = ["Ctx", "ctx", "QUERY_ANALYZER", "RAW", "STOP_ONLY"]
