"""Porter (1980) stemmer as Spark column expressions.

Each step is one CASE expression over the previous step's word, evaluated in
the JVM with Java regexes; the stemmer is meant to be applied to *distinct*
terms (a vocabulary) and joined back, never per token.

Conventions: the word is lower case; a ``y`` that acts as a consonant is
marked as upper-case ``Y`` before the steps and lowered at the end, so the
vowel class is simply ``[aeiouy]`` and everything else is a consonant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V = "[aeiouy]"
C = "[^aeiouy]"
M_GT0 = f"{V}{C}"                      # stem has at least one VC
M_GT1 = f"{V}{C}.*{V}{C}"              # stem has at least two VC
CVC_END = f"{C}{V}[^aeiouywxY]$"       # *o : stem ends consonant-vowel-consonant

# --- fixed values: suffix rules of the 1980 paper -----------------------------
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
# --- end of fixed values --------------------------------------------------------


def _stem(w: Column, n: int) -> Column:
    """w without its last n characters."""
    return w.substr(F.lit(1), F.length(w) - n)


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` bound to a lambda variable: the steps name
    their word many times, and a plain chain of them would grow exponentially
    whenever the optimizer pushes a condition on the stem through it."""
    return F.transform(F.array(value), fn)[0]


def _mark_y(w: Column) -> Column:
    # y at the start, or after a vowel, is a consonant (Y). Runs of y alternate.
    marked = F.aggregate(F.split(w, ""), F.lit(""), lambda done, ch: F.concat(
        done, F.when((ch == "y") & ((done == "") | done.rlike(f"{V}$")), F.lit("Y")).otherwise(ch)))
    return F.when(w.contains("y"), marked).otherwise(w)


def _step1a(w: Column) -> Column:
    return (F.when(w.endswith("sses"), _stem(w, 2))
            .when(w.endswith("ies"), _stem(w, 2))
            .when(w.endswith("ss"), w)
            .when(w.endswith("s"), _stem(w, 1))
            .otherwise(w))


def _step1b(w: Column) -> Column:
    def fix(w: Column) -> Column:
        return (F.when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
                .when(w.rlike(r"([^aeiouylsz])\1$"), _stem(w, 1))
                .when(w.rlike(f"^{C}*{V}+{C}+$") & w.rlike(CVC_END), F.concat(w, F.lit("e")))
                .otherwise(w))
    return (F.when(w.endswith("eed"), F.when(w.rlike(f"{M_GT0}.*eed$"), _stem(w, 1)).otherwise(w))
            .when(w.rlike(f"{V}.*ed$"), _bind(_stem(w, 2), fix))
            .when(w.rlike(f"{V}.*ing$"), _bind(_stem(w, 3), fix))
            .otherwise(w))


def _step1c(w: Column) -> Column:
    return F.when(w.rlike(f"{V}.*[yY]$"), F.concat(_stem(w, 1), F.lit("i"))
                  ).otherwise(w)


def _suffix_step(w: Column, rules, cond: str) -> Column:
    """Longest matching suffix decides; its condition failing ends the step."""
    expr = None
    for suf, rep in sorted(rules, key=lambda r: -len(r[0])):
        val = F.when(w.rlike(f"{cond}.*{suf}$"),
                     F.concat(_stem(w, len(suf)), F.lit(rep))).otherwise(w)
        expr = (F.when(w.endswith(suf), val) if expr is None
                else expr.when(w.endswith(suf), val))
    return expr.otherwise(w)


def _step4(w: Column) -> Column:
    expr = None
    for suf in sorted(STEP4, key=lambda s: -len(s)):
        if suf == "ion":
            ok = w.rlike(f"{M_GT1}.*ion$") & w.rlike("[st]ion$")
        else:
            ok = w.rlike(f"{M_GT1}.*{suf}$")
        val = F.when(ok, _stem(w, len(suf))).otherwise(w)
        expr = (F.when(w.endswith(suf), val) if expr is None
                else expr.when(w.endswith(suf), val))
    return expr.otherwise(w)


def _step5(w: Column) -> Column:
    m1_not_o = (w.rlike(f"{M_GT0}.*e$") & ~w.rlike(f"{M_GT1}.*e$")
                & ~w.rlike(f"{C}{V}[^aeiouywxY]e$"))
    w5a = F.when(w.rlike(f"{M_GT1}.*e$") | m1_not_o, _stem(w, 1)).otherwise(w)
    return w5a


def _step5b(w: Column) -> Column:
    # m is measured on the whole word here (the final l closes a VC)
    return F.when(w.endswith("ll") & w.rlike(M_GT1), _stem(w, 1)).otherwise(w)


def _unmark(w: Column) -> Column:
    return F.regexp_replace(w, "Y", "y")


STEPS = (_mark_y, _step1a, _step1b, _step1c, lambda w: _suffix_step(w, STEP2, M_GT0),
         lambda w: _suffix_step(w, STEP3, M_GT0), _step4, _step5, _step5b, _unmark)


def porter_stem(word: Column) -> Column:
    """Porter stem of a lower-case word; words of one or two characters are
    left unchanged, null stays null."""
    out = word
    for step in STEPS:
        out = _bind(out, step)
    return F.when(F.length(word) <= 2, word).otherwise(out)


def porter_stem_frame(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Add ``dst`` = Porter stem of lower-case word column ``src``."""
    return df.withColumn(dst, porter_stem(F.col(src)))
