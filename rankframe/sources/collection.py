"""Test collections built from the driver tables.

Roles (ids are strings at comparison time):
  corpus   documents(doc_id, text, ...)        → (docno, text, lang, source)
  topics   benchmark(item_id, text)            → (qid, query)
  qrels    documents ⋈ benchmark on containment of the topic text,
           label = 1 + 2·quality (labels table, missing = 0)
  wide     pages(page_id, url, html)           → (docno, title, abstract, url)
  conversations(conv_id, turn, role, text)     → topics (every user turn) and a
           generations table (the assistant turn after it) for query expansion
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN
from ..session import bounded_broadcast, ensure_checkpoint_dir

# --- fixed values ---------------------------------------------------------------
TITLE_PATTERN = r"(?s)<title>(.*?)</title>"
PARAGRAPH_PATTERN = r"(?s)<p>(.*?)</p>"
TAG_PATTERN = r"<[^>]*>"
# topic split: bucket = first 4 hex digits of md5(qid) mod 10
SPLIT_TRAIN_MAX = 5
SPLIT_DEV_MAX = 7
GRAM = 8  # characters of a gram
# --- end of fixed values ----------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("docno"), "text", "lang", "source", "n_chars")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def _words(text) -> "F.Column":
    """The runs between white space, in order."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _grams(text, sizes) -> "F.Column":
    """Hashes of the distinct runs of ``sizes`` characters of a text."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in sizes]
    return F.array_distinct(F.transform(F.concat(*runs), lambda g: F.xxhash64(g)))


def _tokens_around(fragments: DataFrame, doc_words: DataFrame) -> DataFrame:
    """(qid, query, word): the documents' words that hold a topic's fragment.
    Distinct words are indexed by their character grams; a fragment is looked
    up by its first GRAM characters (itself, if shorter)."""
    size = F.least(F.length("fragment"), F.lit(GRAM))
    sizes = sorted(r[0] for r in fragments.select(size).distinct().collect())  # at most GRAM numbers
    keyed = fragments.withColumn("gram", F.xxhash64(F.substring("fragment", F.lit(1), size)))
    words = doc_words.select("word").distinct().select("word", F.explode(_grams(F.col("word"), sizes)).alias("gram"))
    return (words.join(bounded_broadcast(keyed), "gram").filter(F.col("word").contains(F.col("fragment")))
            .select("qid", "query", "word").distinct())


def containment_qrels(corpus_df: DataFrame, topics_df: DataFrame, index=None,
                      labels: DataFrame | None = None) -> DataFrame:
    """Judgments: (qid, docno) where the document text contains the topic text
    verbatim; graded by the labels table. Topics that are null or hold no
    character besides white space judge nothing.

    Equi-joins only. A word of a topic with white space on both sides is a
    whole word of every document that contains the topic, so the topic's rarest
    such word is the key of the join with the documents' distinct words. A
    topic without one (one or two words) has its longest word looked up in the
    vocabulary through an index of character grams, which gives the document
    words that hold it. The verbatim ``contains`` runs on those candidates
    alone. ``index`` isn't needed and is kept for callers that pass one.
    """
    topics = (topics_df.select(F.col("qid").cast("string").alias("qid"), "query").distinct()
              .withColumn("words", _words(F.col("query"))).filter(F.size("words") > 0))
    docs = corpus_df.select("docno", "text")
    doc_words = docs.select("docno", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    own = topics.select("qid", "query", F.size("words").alias("n"), F.posexplode("words").alias("pos", "fragment"))
    left = (F.col("pos") > 0) | F.col("query").rlike(r"^\s")
    right = (F.col("pos") < F.col("n") - 1) | F.col("query").rlike(r"\s$")
    own = own.withColumn("whole", left & right)
    whole = own.filter("whole").select("qid", "query", F.col("fragment").alias("word"))
    counts = (doc_words.join(bounded_broadcast(whole.select("word").distinct()), "word", "left_semi")
              .groupBy("word").agg(F.count("*").alias("df")))
    rarest = Window.partitionBy("qid").orderBy("df", "word")
    keys = (whole.join(counts, "word", "left").na.fill(0, ["df"])  # a word that no document holds: no match
            .withColumn("_rn", F.row_number().over(rarest)).filter((F.col("_rn") == 1) & (F.col("df") > 0))
            .select("qid", "query", "word"))
    longest = Window.partitionBy("qid").orderBy(F.length("fragment").desc(), "pos")
    rest = (own.withColumn("any", F.max("whole").over(Window.partitionBy("qid"))).filter(~F.col("any"))
            .withColumn("_rn", F.row_number().over(longest)).filter("_rn = 1").select("qid", "query", "fragment"))
    if not rest.isEmpty():
        keys = keys.unionByName(_tokens_around(rest, doc_words))
    ensure_checkpoint_dir(keys.sparkSession)
    keys = keys.checkpoint()  # sized and used: one pass over the texts, not two
    cand = doc_words.join(bounded_broadcast(keys), "word").select("qid", "query", "docno").distinct().persist()
    # the candidates are few, so that the texts stay where they are
    matched = (docs.join(bounded_broadcast(cand), "docno").filter(F.col("text").contains(F.col("query")))
               .select("qid", "docno").distinct())
    if labels is None:
        return matched.withColumn("label", F.lit(1))
    lab = labels.select(F.col("doc_id").cast("string").alias("docno"), "quality")
    return (matched.join(lab, "docno", "left")
            .select("qid", "docno",
                    (F.lit(1) + F.lit(2) * F.coalesce(F.col("quality"), F.lit(0)))
                    .cast("int").alias("label")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def wide_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a fielded corpus: title from <title>, abstract = the text of
    every <p>, tags removed, url."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").cast("string").alias("docno"),
        F.regexp_extract("html", TITLE_PATTERN, 1).alias("title"),
        F.trim(F.regexp_replace(F.array_join(F.regexp_extract_all("html", F.lit(PARAGRAPH_PATTERN), 1), " "),
                                TAG_PATTERN, " ")).alias("abstract"),
        "url")


def regex_split(pages: DataFrame, pattern: str = PARAGRAPH_PATTERN) -> DataFrame:
    """Whole text → many documents: every match of ``pattern`` in a page
    becomes a document ``D<page>_<ordinal>`` with tags stripped."""
    blocks = pages.select("page_id", F.posexplode(
        F.regexp_extract_all("html", F.lit(pattern), 1)).alias("pos", "block"))
    return blocks.select(
        F.concat(F.lit("D"), F.col("page_id").cast("string"), F.lit("_"),
                 F.col("pos").cast("string")).alias("docno"),
        F.col("page_id").cast("string").alias("page_id"),
        F.col("pos").cast("bigint").alias("pos"),
        F.trim(F.regexp_replace("block", TAG_PATTERN, "")).alias("text"))


def conversation_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query, raw, conv_id): every user turn as a query, ``qid`` being
    ``conv:turn``, with the text of the assistant turn right after it as the
    raw generation (null when another turn or none follows)."""
    c = table(spark, sf_dir, "conversations")
    after = F.lead(F.struct("role", "text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    g = c.withColumn("after", after).filter((F.col("role") == "user") & F.col("text").isNotNull())
    return g.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("query"),
        F.when(F.col("after.role") == "assistant", F.col("after.text")).alias("raw"), "conv_id")


def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, context): the system turns of a conversation, in order, by line."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "system")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("context"))


def split_bucket(qid) -> "F.Column":
    return F.conv(F.substring(F.md5(F.col(qid).cast("string")), 1, 4), 16, 10).cast("int") % 10


def topic_split(topics_df: DataFrame) -> DataFrame:
    """Deterministic train/dev/test split by a hash of the qid."""
    b = split_bucket("qid")
    return topics_df.withColumn("bucket", b).withColumn(
        "split", F.when(F.col("bucket") <= SPLIT_TRAIN_MAX, "train")
        .when(F.col("bucket") <= SPLIT_DEV_MAX, "dev").otherwise("test"))


def misspell_expr(q) -> "F.Column":
    """Deterministic misspelling: every space-separated word longer than 4
    characters loses its character at position 2 + (length mod 3)."""
    def drop(t):
        p = F.length(t) % 3 + 2
        return F.when(F.length(t) > 4,
                      F.concat(t.substr(F.lit(1), p - 1), t.substr(p + 1, F.length(t)))
                      ).otherwise(t)
    return F.array_join(F.transform(F.split(q, " "), drop), " ")
