"""Inverted index as DataFrames.

``postings(term, docno, tf, dl)`` — the document length is denormalised onto
every posting so ranking never joins the (large) document table;
``lexicon(term, df, cf)``; ``doc_lengths(docno, dl)``; collection statistics as
a small dict (computed by one aggregate job, like the properties file of a
disk index); optional ``positions(term, docno, pos array<int>)`` and fielded
postings.

Build plan: texts are tokenised where they are read (lower-case, length filter,
stopwords — a per-row array expression) and their terms counted there
(``counting``), a batch of documents at a time: no exchange, no table of every
(term, document), and a document's postings follow each other in one task. Only
rows that share their ``docno`` are brought together first. With a stemmer, stems are
computed once per *distinct* token and joined back (AQE splits skewed terms).
Counts over the whole vocabulary are made when they are asked for; a lookup
counts its own terms alone.

A written index keeps its postings, lexicon and positions in folders by a hash
bucket of the term, and the postings once more by a bucket of the document (the
direct index). ``read`` opens only the buckets of the wanted terms or documents.
Every build has a folder of its own and counts once a commit, written last,
names it: a crashed build is never seen, and a forced one replaces the earlier
build at once. Of several commits the last by name holds.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT, Analyzer
from ..session import BROADCAST_MAX_ROWS, bounded_broadcast
from . import counting

COMMIT_SCHEMA = "build string, buckets int, positions boolean, stopwords string, stemmer string, max_term_length int"
BUCKETS = 256   # folders of a stored table; a lookup reads those of its terms or documents
#: stored table → the column whose hash names the bucket, and the columns
STORED = {"postings": ("term", "term string, docno string, tf bigint, dl bigint"),
          "lexicon": ("term", "term string, df bigint, cf bigint"),
          "positions": ("term", "term string, docno string, dl bigint, pos array<int>"),
          "direct": ("docno", "docno string, term string, tf bigint, dl bigint")}


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class Statistics(dict):
    """Collection statistics, counted at first use: those of the documents
    (num_docs, num_tokens, avg_dl) and those of the vocabulary apart."""

    def __init__(self, documents, vocabulary):
        super().__init__()
        self._counts = {**dict.fromkeys(("num_docs", "num_tokens", "avg_dl"), documents),
                        **dict.fromkeys(("num_terms", "num_postings"), vocabulary)}

    def __missing__(self, key):
        self.update(self._counts[key]())
        return self[key]


@dataclass
class Index:
    postings: DataFrame
    lexicon: DataFrame
    doc_lengths: DataFrame
    stats: dict
    analyzer: Analyzer
    positions: DataFrame | None = None
    extra: dict = field(default_factory=dict)
    surface: DataFrame | None = None   # (term, cf) of unstemmed forms; the lexicon without a stemmer
    stored: dict[str, DataFrame] = field(default_factory=dict)   # tables by bucket, of a reopened index
    buckets: int = BUCKETS
    by_document: bool = False   # a document's postings follow each other in one partition

    def read(self, name: str, keys: DataFrame) -> DataFrame:
        """The ``postings``, ``lexicon``, ``positions`` or ``direct`` index
        (docno, term, tf, dl) to look the terms or documents of ``keys`` up in:
        of a stored index only their buckets (at most ``buckets`` numbers reach
        the driver), otherwise the whole table; of a lexicon in memory the
        wanted terms are counted alone, if they can be broadcast."""
        if name not in self.stored:
            if name == "lexicon" and (wanted := keys.select("term").distinct()).count() <= BROADCAST_MAX_ROWS:
                return lexicon_of(self.postings.join(F.broadcast(wanted), "term", "left_semi"))
            return self.postings if name == "direct" else getattr(self, name)
        found = keys.select(bucket_of(STORED[name][0], self.buckets).alias("bucket")).distinct().collect()
        return self.stored[name].filter(F.col("bucket").isin([r["bucket"] for r in found])).drop("bucket")

    # -- identity ---------------------------------------------------------
    @cached_property
    def identity(self) -> str:
        """Digest of the contents: equal for indexes with the same postings,
        wherever they lie (one pass over the postings, at first use)."""
        row = self.postings.agg(
            F.count("*"), F.sum(F.xxhash64("term", "docno", "tf", "dl").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("docno", "term", "tf"))).first()
        return hashlib.md5(repr([str(x) for x in row] + [self.stats["num_docs"]]).encode()).hexdigest()

    # -- statistics -------------------------------------------------------
    @property
    def num_docs(self) -> float:
        return float(self.stats["num_docs"])

    @property
    def num_tokens(self) -> float:
        return float(self.stats["num_tokens"])

    @property
    def avg_dl(self) -> float:
        return float(self.stats["avg_dl"])

    def stats_frame(self, spark: SparkSession) -> DataFrame:
        s = self.stats
        return spark.createDataFrame(
            [(int(s["num_docs"]), int(s["num_tokens"]), int(s["num_terms"]),
              int(s["num_postings"]), float(s["avg_dl"]))],
            "num_docs bigint, num_tokens bigint, num_terms bigint, "
            "num_postings bigint, avg_dl double")

    # -- persistence ------------------------------------------------------
    def write(self, path: str, mode: str = "errorifexists", buckets: int = BUCKETS) -> "Index":
        """Write a build below ``path`` and commit it. ``mode``: errorifexists
        refuses a path with a committed index, overwrite commits a new build."""
        spark = self.postings.sparkSession
        done = _commits(spark, path)
        if done and mode != "overwrite":
            raise FileExistsError(f"{path} holds an index")
        build = uuid.uuid4().hex
        folder = os.path.join(path, "builds", build)
        if self.positions is None:
            rows = self.postings.select("term", "docno", "tf", "dl")
        else:
            rows = self.positions.select("term", "docno", F.size("pos").cast("bigint").alias("tf"),
                                         F.col("dl").cast("bigint").alias("dl"), "pos")
        # the direct index is written where its documents are; what is kept by
        # term comes from it, so that the texts are tokenised once
        direct = os.path.join(folder, "direct")
        (rows.withColumn("bucket", bucket_of("docno", buckets)).sortWithinPartitions("bucket")
         .write.partitionBy("bucket").parquet(direct))
        rows = spark.read.schema(f"{_columns('direct', self.positions is not None)}, bucket int").parquet(direct).drop("bucket")
        # ranges cut a frequent term's bucket into several files, by document
        order = ["bucket", "term", "docno"]
        (rows.withColumn("bucket", bucket_of("term", buckets)).repartitionByRange(*order)
         .sortWithinPartitions(*order).write.partitionBy("bucket").parquet(os.path.join(folder, "postings")))
        lexicon = lexicon_of(_stored_table(spark, folder, "postings"))
        (lexicon.withColumn("bucket", bucket_of("term", buckets)).repartitionByRange("bucket", "term")
         .sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(os.path.join(folder, "lexicon")))
        self.doc_lengths.write.parquet(os.path.join(folder, "doc_lengths"))
        lexicon = _stored_table(spark, folder, "lexicon")
        written = spark.read.schema("docno string, dl bigint").parquet(os.path.join(folder, "doc_lengths"))
        counted = replace(self, stats=_document_counts(written, lexicon, "cf") | _vocabulary_counts(lexicon))
        counted.stats_frame(spark).coalesce(1).write.parquet(os.path.join(folder, "collection_stats"))
        if self.surface is not None:
            surface = self.surface if self.analyzer.stemmer else _stored_table(spark, folder, "lexicon").select("term", "cf")
            surface.write.parquet(os.path.join(folder, "surface"))
        number = int(os.path.basename(done[-1]).split("-")[0]) + 1 if done else 0
        (spark.createDataFrame([(build, buckets, self.positions is not None, self.analyzer.stopwords,
                                 self.analyzer.stemmer, self.analyzer.max_term_length)], COMMIT_SCHEMA)
         .coalesce(1).write.parquet(os.path.join(path, "commits", f"{number:012d}-{build}")))
        return self

    @staticmethod
    def load(spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> "Index":
        """Reopen a written index with the analyzer it was built with; another
        ``analyzer`` is an error, for its terms would not be found."""
        from ..sinks import path_exists
        done = _commits(spark, path)
        if not done:
            raise FileNotFoundError(f"{path} holds no committed index")
        commit = spark.read.schema(COMMIT_SCHEMA).parquet(done[-1]).first()
        found = Analyzer(commit["stopwords"], commit["stemmer"], commit["max_term_length"])
        if analyzer is not None and analyzer != found:
            raise ValueError(f"{path} was indexed with {found}, not {analyzer}")
        folder = os.path.join(path, "builds", commit["build"])
        stored = {name: _stored_table(spark, folder, name)
                  for name in STORED if name != "positions" or commit["positions"]}
        whole = {name: df.drop("bucket") for name, df in stored.items()}
        surface = os.path.join(folder, "surface")
        return Index(
            postings=whole["postings"], lexicon=whole["lexicon"], positions=whole.get("positions"),
            doc_lengths=spark.read.parquet(os.path.join(folder, "doc_lengths")),
            stats=spark.read.parquet(os.path.join(folder, "collection_stats")).first().asDict(), analyzer=found,
            surface=spark.read.parquet(surface) if path_exists(spark, surface) else None,
            stored=stored, buckets=commit["buckets"])

    @staticmethod
    def open_or_build(corpus: DataFrame, path: str, analyzer: Analyzer = DEFAULT, force: bool = False,
                      buckets: int = BUCKETS, **options) -> "Index":
        """The index at ``path``, built from ``corpus`` and written if there is
        none, if it lacks the positions that are asked for, or if ``force`` is set."""
        spark = corpus.sparkSession
        done = _commits(spark, path)
        lacking = (done and options.get("positions")
                   and not spark.read.schema(COMMIT_SCHEMA).parquet(done[-1]).first()["positions"])
        if force or not done or lacking:
            # dealt by document, so that a task writes few of the direct index's folders
            built = build_index(corpus, analyzer, persist=False, deal=bucket_of("docno", buckets), **options)
            built.write(path, mode="overwrite", buckets=buckets)
            built.unpersist()
        return Index.load(spark, path, analyzer)

    def persist(self) -> "Index":
        lvl = StorageLevel.MEMORY_AND_DISK
        self.postings.persist(lvl)
        self.lexicon.persist(lvl)
        self.doc_lengths.persist(lvl)
        if self.positions is not None:
            self.positions.persist(lvl)
        return self

    def unpersist(self) -> None:
        for df in (self.postings, self.lexicon, self.doc_lengths, self.positions, self.surface):
            if df is not None:
                df.unpersist()


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete commits of an index, first to last."""
    from ..sinks import child_folders, path_exists
    return [f for f in child_folders(spark, os.path.join(path, "commits")) if path_exists(spark, f"{f}/_SUCCESS")]


def _columns(name: str, positions: bool = False) -> str:
    return STORED[name][1] + (", pos array<int>" if positions else "")


def _stored_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a written build with its ``bucket``. Postings and positions
    are columns of one table."""
    rows = spark.read.schema(f"{_columns(name)}, bucket int")
    return rows.parquet(os.path.join(folder, "postings" if name == "positions" else name))


def analysed_tokens(corpus: DataFrame, analyzer: Analyzer, text_col: str = "text",
                    with_positions: bool = False) -> DataFrame:
    """(docno, dl, term[, pos]) — one row per kept token occurrence, stemmed.

    ``dl`` (indexed tokens of the document) is the size of the token array,
    computed before the explode, so it needs no aggregation.
    """
    docs = corpus.select("docno", analyzer.tokens(F.col(text_col)).alias("toks"))
    docs = docs.select("docno", F.size("toks").alias("dl"), "toks")
    if with_positions:
        rows = (docs.select("docno", "dl", F.posexplode_outer("toks").alias("pos", "raw"))
                .filter(F.col("raw").isNotNull()))
    else:
        rows = _each_token(docs, "raw")
    if analyzer.stemmer is None:
        return rows.withColumnRenamed("raw", "term")
    vocab = analyzer.stem_frame(rows.select("raw").distinct(), "raw", "term")
    return rows.join(vocab, "raw").drop("raw")


def _each_token(docs: DataFrame, name: str) -> DataFrame:
    """(docno, dl, <name>), a row a token. The outer form keeps Spark from
    tokenising twice: it would look for empty arrays before the texts move."""
    return (docs.select("docno", F.size("toks").alias("dl"), F.explode_outer("toks").alias(name))
            .filter(F.col(name).isNotNull()))


def build_index(corpus: DataFrame, analyzer: Analyzer = DEFAULT,
                text_col: str = "text", positions: bool = False,
                persist: bool = True, deal: Column | None = None) -> Index:
    """Index a corpus ``(docno string, text string, ...)``. With ``deal`` the
    texts are dealt by ranges of it and of docno before they are counted."""
    doc_lengths = corpus.select("docno", F.size(analyzer.tokens(F.col(text_col))).cast("bigint").alias("dl"))
    texts = corpus.select("docno", F.col(text_col).alias("text"))
    if deal is not None:
        parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = texts.repartitionByRange(parts, deal, "docno")
    docs = _once(texts.select("docno", counting.joined_tokens(analyzer, F.col("text")).alias("words")),
                 corpus.select("docno"))
    raw = counting.postings_of(docs)
    if analyzer.stemmer is None:
        postings = raw
    else:
        # the tokens of a document are counted, the distinct vocabulary is
        # stemmed and joined back, terms that share a stem are added up
        raw = raw.withColumnRenamed("term", "raw")
        vocab = analyzer.stem_frame(raw.select("raw").distinct(), "raw", "term")
        postings = (raw.join(vocab, "raw").groupBy("term", "docno", "dl").agg(F.sum("tf").alias("tf"))
                    .select("term", "docno", "tf", "dl"))
    lexicon = lexicon_of(postings)
    surface = lexicon.select("term", "cf") if analyzer.stemmer is None else (
        raw.groupBy(F.col("raw").alias("term")).agg(F.sum("tf").cast("bigint").alias("cf")))

    pos_df = None
    if positions:
        pos_df = counting.postings_of(docs, positions=True) if analyzer.stemmer is None else (
            analysed_tokens(corpus, analyzer, text_col, with_positions=True)
            .groupBy("term", "docno", "dl").agg(F.array_sort(F.collect_list("pos")).alias("pos")))
        pos_df = pos_df.select("term", "docno", F.col("dl").cast("int").alias("dl"), "pos")

    idx = Index(postings, lexicon, doc_lengths, {}, analyzer, pos_df,
                extra={"corpus": corpus.select("docno", F.col(text_col).alias("text"))}, surface=surface,
                by_document=analyzer.stemmer is None)
    if persist:
        idx.persist()
    idx.stats = collection_statistics(idx)
    return idx


def _once(docs: DataFrame, docnos: DataFrame) -> DataFrame:
    """(docno, words, copies) of (docno, words), whose ids ``docnos`` holds: rows of one document with equally many words
    become one, ``copies`` of them one after the other; only rows whose docno
    comes more than once move."""
    alone = docs.withColumn("copies", F.lit(1))
    repeated = docnos.groupBy("docno").agg(F.count("*").alias("n")).filter("n > 1").select("docno")
    n = repeated.count()
    if n == 0:
        return alone
    repeated = bounded_broadcast(repeated.withColumnRenamed("docno", "again"), known_rows=n)
    same = F.col("docno").eqNullSafe(F.col("again"))
    size = F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " ")))
    merged = (docs.join(repeated, same, "left_semi").withColumn("size", size).groupBy("docno", "size")
              .agg(F.array_join(F.collect_list("words"), " ").alias("words"), F.count("*").cast("int").alias("copies")))
    return alone.join(repeated, same, "left_anti").unionByName(merged.drop("size"))


def lexicon_of(postings: DataFrame) -> DataFrame:
    """(term, df, cf) of the postings' terms."""
    return postings.groupBy("term").agg(
        F.count("*").cast("bigint").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def collection_statistics(idx: Index) -> dict:
    """N, tokens and mean length, vocabulary and pointers, when they are asked for."""
    return Statistics(lambda: _document_counts(idx.extra["corpus"], idx.postings, "tf"),
                      lambda: _vocabulary_counts(idx.lexicon))


def _document_counts(docs: DataFrame, counted: DataFrame, count: str) -> dict:
    """N, tokens and mean length; the tokens are the sum of ``count``, so that
    the texts aren't tokenised for their lengths."""
    n = docs.select("docno").count()
    c = int(counted.agg(F.sum(count)).first()[0] or 0)
    return {"num_docs": n, "num_tokens": c, "avg_dl": (c / n) if n else 0.0}


def _vocabulary_counts(lexicon: DataFrame) -> dict:
    lx = lexicon.agg(F.count("*").alias("v"), F.sum("df").alias("p")).first()
    return {"num_terms": int(lx["v"] or 0), "num_postings": int(lx["p"] or 0)}


def term_positions(idx: Index, terms: DataFrame) -> DataFrame:
    """(term, docno, dl, p) for the given (bounded) set of terms only: from the
    positional index when it was built, otherwise by one positional
    tokenisation of the corpus filtered map-side to those terms."""
    t = bounded_broadcast(terms.select("term").distinct())
    if idx.positions is not None:
        return (idx.read("positions", terms).join(t, "term")
                .select("term", "docno", "dl", F.explode("pos").alias("p")))
    if "corpus" not in idx.extra:
        raise ValueError("the index holds no positions: build it with positions=True")
    toks = analysed_tokens(idx.extra["corpus"], idx.analyzer, "text", with_positions=True)
    return toks.join(t, "term").select("term", "docno", "dl", F.col("pos").alias("p"))


def doc_term_bags(idx: Index) -> DataFrame:
    """Direct index: docno → array of (term, tf) sorted by term."""
    return (idx.postings.groupBy("docno")
            .agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms")))


def fielded_postings(corpus: DataFrame, fields: list[str],
                     analyzer: Analyzer = DEFAULT) -> DataFrame:
    """(field, term, docno, tf): one pass over all fields via a stacked array
    of (field, text) structs, so the corpus is scanned once."""
    stacked = corpus.select(
        "docno",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"),
                                     F.coalesce(F.col(f), F.lit("")).alias("text"))
                            for f in fields])).alias("ft"))
    stacked = stacked.select("docno", F.col("ft.field").alias("field"),
                             F.col("ft.text").alias("text"))
    toks = stacked.select("docno", "field",
                          F.explode(analyzer.tokens(F.col("text"))).alias("raw"))
    if analyzer.stemmer is not None:
        vocab = analyzer.stem_frame(toks.select("raw").distinct(), "raw", "term")
        toks = toks.join(vocab, "raw").drop("raw")
    else:
        toks = toks.withColumnRenamed("raw", "term")
    return (toks.groupBy("field", "term", "docno")
            .agg(F.count("*").cast("bigint").alias("tf")))


def doc_meta(corpus: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """Stored metadata cropped to a maximum length per column."""
    return corpus.select("docno", *[F.substring(F.col(c), 1, n).alias(c)
                                    for c, n in lengths.items()])
