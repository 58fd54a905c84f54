"""Text analysis as Column expressions (JVM-side, codegen'd).

Everything here builds ``pyspark.sql.Column`` objects; nothing runs Python
per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Token pattern: maximal runs of Unicode letters and digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Longest indexed term (longer tokens are dropped).
MAX_TERM_LENGTH = 20
# English stopword list (our own list of function words), alphabetical.
ENGLISH_STOPWORDS = (
    "a about above after again against all am an and any are as at be "
    "because been before being below between both but by can could did do "
    "does doing down during each few for from further had has have having he "
    "her here hers herself him himself his how i if in into is it its itself "
    "just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that "
    "the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which "
    "while who whom why will with would you your yours yourself yourselves"
).split()
# Line boundaries of Python's str.splitlines(), written so that both Java
# regexes and RE2 accept the pattern.
LINE_SPLIT_PATTERN = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# --- end of fixed values ------------------------------------------------------

STOPWORD_LISTS = {"en": ENGLISH_STOPWORDS}


def raw_tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


@dataclass(frozen=True)
class Analyzer:
    """Term pipeline shared by the index and the query side.

    ``stopwords``: name of a stopword list or None; ``stemmer``: "porter" or
    None; tokens longer than ``max_term_length`` are dropped.
    """

    stopwords: str | None = "en"
    stemmer: str | None = "porter"
    max_term_length: int = MAX_TERM_LENGTH

    def tokens(self, text: Column) -> Column:
        """Array of kept (un-stemmed) tokens in text order."""
        toks = raw_tokens(text)
        stop = STOPWORD_LISTS[self.stopwords] if self.stopwords else []
        n = self.max_term_length

        def keep(t):
            cond = F.length(t) <= n
            if stop:
                cond = cond & ~t.isin(*stop)
            return cond

        return F.filter(toks, keep)

    def stem_frame(self, df: DataFrame, src: str, dst: str) -> DataFrame:
        """Add column ``dst`` = stem of ``src`` (identity without stemmer)."""
        if self.stemmer is None:
            return df.withColumn(dst, F.col(src))
        if self.stemmer == "porter":
            from .porter import porter_stem_frame
            return porter_stem_frame(df, src, dst)
        raise ValueError(f"unknown stemmer {self.stemmer!r}")


RAW = Analyzer(stopwords=None, stemmer=None)
STOP_ONLY = Analyzer(stopwords="en", stemmer=None)
DEFAULT = Analyzer()


def sanitize(q: Column) -> Column:
    """lower → every non letter/digit/underscore/space char to a space →
    collapse whitespace → trim. ``\\p`` classes keep accented letters."""
    s = F.regexp_replace(F.lower(q), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_generation(line: Column) -> Column:
    """Clean one generated line: strip, drop a leading bullet/number run,
    strip quote characters at both ends, collapse whitespace."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"^[\-\*\d\.\)]+\s*", "")
    s = F.regexp_replace(s, "^[\"'`]+|[\"'`]+$", "")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^ | $", "")


def split_lines(raw: Column) -> Column:
    return F.split(raw, LINE_SPLIT_PATTERN)


def word_set(text: Column) -> Column:
    """Distinct lower-cased tokens of a text (for Jaccard features)."""
    return F.array_distinct(raw_tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """|A∩B| / |A∪B| over token sets; 0 when both are empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        inter.cast("double") / union.cast("double"))
