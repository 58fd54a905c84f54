"""Personal data by weak supervision (DataFrame functions only).

*Candidates.* Every kind has one pattern; its matches in a text, with the text
around each, are the candidates. Positions come from the lengths of the pieces
between the matches. The patterns start where a run of their characters
starts, and take runs whole, so that a long run is read once.

*Labelers* look at a candidate and vote for personal data (1), against it (-1)
or not at all (0): the shape of the value and its check digits (regex),
gazetteers (issuers, calling codes, first names, titles, top-level domains,
reserved ranges), and the context (cue words before the value, the characters
at its ends, placeholders, other kinds in the same text). Candidates whose
votes agree are one cell, so at most 3^8 cells a kind are kept, whatever the
corpus.

*Expectation-maximisation* estimates, without any label, per kind the share of
personal data and how often each labeler votes each way on personal data and
on other text. An abstention says nothing, and no labeler is believed to mean
the opposite of its vote. A step is one aggregation of the cells; only the
parameters return.

*The span classifier* is a logistic regression (MLlib) on features that the
labelers don't see as such: kind, length, share of digits, the characters and
the word before and after. It is trained on the cells of these features,
weighted by the posteriors.

The four base kinds (``BASE``) stay by their own rules (``passes``); the
method adds the candidates of the other kinds (``ADDED``) that the classifier
accepts and that touch no base span.

Only candidates are shuffled, with at most ``BEFORE + AFTER`` code points of
context; texts are read once.

Defined cases: a null text is empty; null and empty texts have no span, and
the hash of an empty list; repeated rows are searched each; null ids stay
null; without any candidate nothing is learned and nothing added; an empty
table gives an empty result; further columns are ignored. Spans are in code
points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder, written

# --- fixed values ---------------------------------------------------------------
BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "national_phone", "iban", "ssn", "person")
KINDS = BASE + ADDED
BEFORE, AFTER = 40, 12
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Don Doña".split()
FIRST_NAMES = """Ahmed Alice Ana Andreas Anna Anne Antoine Antonio Barbara Carlos Carmen Charles Christine Claire Daniel
David Elizabeth Emily Emma Eva Fatima François Frank Gabriel George Hannah Hans Heinrich Helen Henry Isabel Jacques
James Jane Javier Jean Jennifer Johann John José Joseph Juan Julia Karl Kevin Klaus Laura Linda Lucia Luis Louis Manuel
Margaret Maria María Marie Mark Martin Mary Matthias Michael Michel Miguel Mohammed Nicole Olivia Pablo Patricia Paul
Pedro Peter Philippe Pierre Rachel Richard Robert Sarah Sofia Sophie Stefan Susan Thomas Ursula William Wolfgang""".split()
_LOCAL = "A-Za-z0-9._%+-"
_NAME = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?"
#: Base patterns as the rules give them, written so that a run is read once.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++"
                     r"(?:(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]++)++"),
    "national_phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": (rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?|{'|'.join(FIRST_NAMES)})"
               rf"\x20{_NAME}(?:\x20{_NAME})?(?!\p{{L}})"),
}
#: What a text must hold for a pattern to match at all.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
         "masked_email": r"[(\[]at[)\]]", "national_phone": r"[0-9]{3}[-.\x20][0-9]{4}",
         "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "person": PATTERNS["person"]}
CUES = {"email": "e-?mail|contact|write|reach|schreib|correo|courriel|address", "ip": "ip|host|server|client|address|adresse",
        "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|paid|payment",
        "phone": "phone|tel|call|mobile|fax|cell|reach|ruf|handy|portable|llam|móvil",
        "masked_email": "e-?mail|contact|write|reach|correo|courriel", "national_phone": "phone|tel|call|mobile|fax|cell|reach",
        "iban": "iban|account|bank|konto|compte|cuenta|transfer", "ssn": "ssn|social|security|number",
        "person": "name|contact|dear|signed|regards|author|by|patient|customer|client|ich bin|je suis|soy|i am"}
AGAINST = r"(?i)(?:version|ver|order|invoice|isbn|issn|doi|ref|section|chapter|page|port|build|sku|serial|id|no|nr|fig|table)[.:#]?\s*$"
PLACEHOLDER = r"(?i)0000000|1111111|9999999|1234567|xxxx|example|placeholder|john doe|jane doe"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|64[4-9]|65)"
CALLING = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|[2-9][0-9]{2})"
RESERVED = r"^(?:0|10|127|255|2[2-4][0-9])\.|^192\.168\.|^169\.254\."
TOP_LEVEL = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|us|ca|mx|ar|co|me)$"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
LABELERS = ("shape", "checksum", "gazetteer", "cue", "against", "edges", "placeholder", "company")
STEPS, TOLERANCE, PSEUDO = 25, 1e-3, 10.0
FEATURES = ("kind", "length", "digits", "left", "right", "word")
HASHED, WORD_BUCKETS, RIDGE = 1024, 64, 0.05
THRESHOLD = 0.5
# --- end of fixed values ----------------------------------------------------------

_STARTING = {1: {1: 0.60, 0: 0.35, -1: 0.05}, 0: {1: 0.15, 0: 0.40, -1: 0.45}}


# ------------------------------------------------------------------- candidates
def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the matches of every pattern, with the lengths between
    them and what stands around each."""
    text = F.coalesce("text", F.lit(""))
    none, rows = F.array().cast("array<string>"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def gated(kind: str, value: Column) -> Column:
        gate = F.col("text").contains("@") if kind == "email" else F.col("text").rlike(GATES[kind])
        return F.when(gate, value).otherwise(none)
    cut = rows.select("doc_id", *[gated(k, F.split("text", PATTERNS[k], -1)).alias(k) for k in KINDS],
                      *[gated(k, F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).alias(f"{k}_at")
                        for k in KINDS])

    def entries(kind: str) -> Column:
        def entry(value: Column, i: Column) -> Column:
            gap, rest = F.get(kind, i), F.get(kind, i + 1)
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(gap).alias("gap"),
                            F.length(value).alias("size"), value.alias("value"),
                            F.substring(gap, -BEFORE, BEFORE).alias("before"),
                            F.substring(rest, 1, AFTER).alias("after"))
        return F.transform(f"{kind}_at", entry)
    return cut.select("doc_id", F.concat(*[entries(k) for k in KINDS]).alias("found"))


def luhn(digits: Column) -> Column:
    """Whether the last digit of at most 19 checks the others."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for k in range(19):
        d = F.substring(padded, 19 - k, 1).cast("int")
        total = total + (d if k % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, its first four
    characters last and letters counted from 10."""
    bare = F.translate(value, " ", "")
    turned = F.concat(F.substring(bare, 5, 60), F.substring(bare, 1, 4))

    def step(left: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (left * 100 + code - 55) % 97).otherwise((left * 10 + code - 48) % 97)
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step) == 1


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes() -> Column:
    """The base kinds' own rules; null for the other kinds."""
    kind, value, n = F.col("kind"), F.col("value"), F.length(digits_of(F.col("value")))
    return (F.when(kind == "email", True)
            .when(kind == "ip", value.rlike(OCTETS))
            .when(kind == "card", F.when(n.between(12, 19), luhn(digits_of(value))).otherwise(False))
            .when(kind == "phone", n.between(9, 15)))


def spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, before, after, passes) of every candidate."""
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (scanned.select("row", F.inline("found"))
            .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
            .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value", "before", "after",
                    passes().alias("passes")))


# --------------------------------------------------------------------- labelers
def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(found: DataFrame) -> DataFrame:
    """``found`` with one column of votes (1, 0, -1) per labeler."""
    kind, value = F.col("kind"), F.col("value")
    digits, never = digits_of(value), F.lit(False)
    n = F.length(digits)
    first = F.regexp_extract(value, r"^\p{L}+", 0)

    def by_kind(rules: dict[str, tuple[Column, Column]]) -> Column:
        out = F.lit(0)
        for k, (yes, no) in rules.items():
            out = F.when(kind == k, _vote(yes, no)).otherwise(out)
        return out.cast("int")

    def or_not(yes: Column) -> tuple[Column, Column]:
        return yes, ~yes
    shape = by_kind({
        "email": or_not(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}$")),
        "ip": or_not(value.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$")),
        "card": or_not(value.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$")),
        "phone": or_not(n.between(9, 15) & ~value.rlike(r"\([^)]*\(|[.-]{2}")),
        "masked_email": or_not(value.rlike(r"[A-Za-z]{2,24}$")),
        "national_phone": or_not(digits.rlike("^[2-9][0-9]{2}[2-9]")),
        "iban": or_not(F.length(F.translate(value, " ", "")).between(15, 34)),
        "ssn": or_not(~value.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        "person": or_not(F.size(F.array_distinct(F.split(value, r"\x20"))) == F.size(F.split(value, r"\x20"))),
    })
    checksum = by_kind({
        "ip": or_not(value.rlike(OCTETS)),
        "card": or_not(F.when(n.between(12, 19), luhn(digits)).otherwise(False)),
        "iban": or_not(mod97(value)),
    })
    gazetteer = by_kind({
        "email": (value.rlike(TOP_LEVEL), never),
        "ip": (never, value.rlike(RESERVED)),
        "card": or_not(digits.rlike(ISSUERS)),
        "phone": or_not(value.rlike(CALLING)),
        "masked_email": (value.rlike(r"(?i)(?:\.|[)\]]\x20?)(?:com|org|net|edu|de|fr|es|uk|eu|io)$"), never),
        "iban": or_not(value.rlike("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)")),
        "person": (F.array_contains(F.array(*[F.lit(x) for x in FIRST_NAMES]), first)
                   | F.array_contains(F.array(*[F.lit(x) for x in TITLES]), first), never),
    })
    cue = by_kind({k: (F.col("before").rlike(rf"(?i)(?<!\p{{L}})(?:{c})"), never) for k, c in CUES.items()})
    left, right = F.substring("before", -1, 1), F.substring("after", 1, 1)
    free = r"^[\s,;:.!?()\[\]<>\"'#*%&]?$"
    edges = _vote(left.rlike(free) & right.rlike(free), left.rlike(r"[\p{L}\p{N}_/=@-]") | right.rlike(r"[\p{L}\p{N}_/=@]"))
    company = F.size(F.collect_set("kind").over(Window.partitionBy("row"))) > 1
    return (found.withColumn("shape", shape).withColumn("checksum", checksum).withColumn("gazetteer", gazetteer)
            .withColumn("cue", cue).withColumn("against", _vote(never, F.col("before").rlike(AGAINST)))
            .withColumn("edges", edges).withColumn("placeholder", _vote(never, value.rlike(PLACEHOLDER)))
            .withColumn("company", _vote(company, never)))


# ------------------------------------------------------- expectation-maximisation
@dataclass(frozen=True)
class Reliability:
    """prior[kind]: share of personal data; rate[kind][labeler][class][vote]."""
    prior: dict[str, float]
    rate: dict[str, dict[str, dict[int, dict[int, float]]]]

    def weight(self, kind: str, labeler: str, vote: int) -> float:
        """What a vote adds to the log odds: nothing against its own sense."""
        r = self.rate[kind][labeler]
        return vote * max(0.0, vote * math.log(r[1][vote] / r[0][vote])) if vote else 0.0

    def posterior(self) -> Column:
        """Probability that a candidate with its votes is personal data."""
        odds = F.lit(0.0)
        for k, p in self.prior.items():
            one = F.lit(math.log(p / (1 - p)))
            for name in LABELERS:
                one = one + F.when(F.col(name) == 1, self.weight(k, name, 1)).when(
                    F.col(name) == -1, self.weight(k, name, -1)).otherwise(0.0)
            odds = F.when(F.col("kind") == k, one).otherwise(odds)
        return 1 / (1 + F.exp(-odds))


def starting() -> Reliability:
    return Reliability({k: 0.5 for k in KINDS}, {
        k: {name: {c: dict(r) for c, r in _STARTING.items()} for name in LABELERS} for k in KINDS})


def em_step(cells: DataFrame, now: Reliability) -> Reliability:
    """One step over the cells (kind, votes, n). Rates are smoothed by PSEUDO
    candidates as the start has them: none is 0, and a rare kind stays near it."""
    c = cells.withColumn("yes", F.col("n") * now.posterior())
    sums = [F.sum(F.when(F.col(name) == v, F.col(x)).otherwise(0)).alias(f"{name}{v}{x}")
            for name in LABELERS for v in (1, 0, -1) for x in ("yes", "n")]
    got = {r["kind"]: r for r in c.groupBy("kind").agg(*sums, F.sum("yes").alias("yes"), F.sum("n").alias("n")).collect()}
    prior, rate = {}, {}
    for k in KINDS:  # at most one row per kind
        r = got.get(k)
        whole = {1: r["yes"], 0: r["n"] - r["yes"]} if r else {1: 0.0, 0: 0.0}

        def held(name: str, cls: int, v: int) -> float:
            if not r:
                return 0.0
            return max(r[f"{name}{v}yes"] if cls else r[f"{name}{v}n"] - r[f"{name}{v}yes"], 0.0)
        prior[k] = (whole[1] + PSEUDO / 2) / (whole[0] + whole[1] + PSEUDO)
        rate[k] = {name: {cls: {v: (held(name, cls, v) + PSEUDO * _STARTING[cls][v]) / (whole[cls] + PSEUDO)
                                for v in (1, 0, -1)} for cls in (1, 0)} for name in LABELERS}
    return Reliability(prior, rate)


def learn_reliability(cells: DataFrame, steps: int = STEPS) -> Reliability:
    """The labelers' rates after at most ``steps`` steps, fewer when the shares settle."""
    now = starting()
    for _ in range(steps):
        new = em_step(cells, now)
        moved = max(*(abs(new.prior[k] - now.prior[k]) for k in KINDS),
                    *(abs(new.rate[k][name][c][v] - now.rate[k][name][c][v])
                      for k in KINDS for name in LABELERS for c in (0, 1) for v in (1, 0, -1)))
        now = new
        if moved < TOLERANCE:
            break
    return now


# ---------------------------------------------------------------- span classifier
def described(found: DataFrame) -> DataFrame:
    """``found`` with the classifier's features, each of few values."""
    size = F.length("value")

    def edge(c: Column) -> Column:
        return (F.when(c == "", "end").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter")
                .when(c.rlike(r"\p{N}"), "digit").otherwise("mark"))
    word = F.lower(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1))
    return (found.withColumn("length", F.least(F.floor(size / 3), F.lit(12)).cast("string"))
            .withColumn("digits", F.round(4 * F.length(digits_of(F.col("value"))) / size).cast("string"))
            .withColumn("left", edge(F.substring("before", -1, 1))).withColumn("right", edge(F.substring("after", 1, 1)))
            .withColumn("word", F.when(word == "", "").otherwise(F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("string"))))


def _hasher() -> FeatureHasher:
    return FeatureHasher(inputCols=list(FEATURES), categoricalCols=list(FEATURES), numFeatures=HASHED, outputCol="features")


def learn_classifier(found: DataFrame, reliability: Reliability):
    """Logistic regression on the cells of the features; None without candidates."""
    cells = checkpointed(found.withColumn("yes", reliability.posterior()).groupBy(*FEATURES)
                         .agg(F.sum("yes").alias("yes"), F.count("*").alias("n")))
    total = cells.agg(F.sum("n")).first()[0]
    if not total:
        return None
    both = cells.select(*FEATURES, F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.greatest(F.col("n") - F.col("yes"), F.lit(0.0)).alias("weight")))).alias("x"))
    train = _hasher().transform(both.select(*FEATURES, "x.label", "x.weight").filter("weight > 0"))
    return LogisticRegression(weightCol="weight", regParam=RIDGE / total, maxIter=50).fit(train)


def with_score(found: DataFrame, model) -> DataFrame:
    """``found`` with the classifier's ``score`` (0 without a model)."""
    if model is None:
        return found.withColumn("score", F.lit(0.0))
    return (model.transform(_hasher().transform(found)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
            .drop("features", "rawPrediction", "probability", "prediction"))


# ------------------------------------------------------------------------- result
def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def accepted(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base spans that pass, and added ones that the classifier accepts and
    that touch no base span."""
    base = F.col("passes").isNotNull()
    # base spans before an added one in this order start no later than it
    order = Window.partitionBy("row").orderBy("start", F.when(base, 0).otherwise(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    kept = scored.filter(F.col("passes") | (F.col("passes").isNull() & (F.col("score") >= threshold)))
    touched = ((F.max(F.when(base, F.col("end"))).over(before) > F.col("start"))
               | (F.min(F.when(base, F.col("start"))).over(after) < F.col("end")))
    return kept.withColumn("touched", F.coalesce(touched, F.lit(False))).filter(base | ~F.col("touched")).drop("touched")


class Detector:
    """Candidates of a corpus, the labelers' reliability and the span classifier."""

    def __init__(self, docs: DataFrame):
        self.scanned = written(scan(docs).withColumn("row", F.monotonically_increasing_id()),
                               shared_folder(docs.sparkSession), "candidates")
        self.found = checkpointed(described(votes(spans(self.scanned))))
        cells = checkpointed(self.found.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")))
        self.reliability = learn_reliability(cells)
        self.model = learn_classifier(self.found, self.reliability)

    def spans(self, threshold: float = THRESHOLD) -> DataFrame:
        """(row, kind, start, end, value, score) of all accepted spans."""
        return accepted(with_score(self.found, self.model), threshold).select(
            "row", "kind", "start", "end", "value", "score")

    def documents(self, threshold: float = THRESHOLD) -> DataFrame:
        """doc_id, the base kinds' numbers, base_sha256, spans and n_added of every row."""
        entry = F.struct("start", rank_of(F.col("kind")).alias("rank"), "end", "kind")
        held = (self.spans(threshold).groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("s")))  # of one document
        rows = self.scanned.select("doc_id", "row").join(held, "row", "left").withColumn(
            "s", F.coalesce("s", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
        base = F.filter("s", lambda x: x["rank"] <= len(BASE))

        def listed(x: Column) -> Column:
            return F.array_join(F.transform(x, lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

        def number(kind: str) -> Column:
            return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
        return rows.select("doc_id", *[number(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                           listed(F.col("s")).alias("spans"), (F.size("s") - F.size(base)).cast("long").alias("n_added"))


def find(docs: DataFrame) -> DataFrame:
    """The result of ``Detector.documents`` for ``docs``."""
    return Detector(docs).documents()
