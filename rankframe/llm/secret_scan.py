"""Secret scans with corpus-wide ownership frequency.

Every text is searched for credential-like candidates. The value of each
candidate is hashed, and for each hash the distinct repositories and distinct
owners that hold it are counted over the whole corpus. Both counts decide
(``kind_of``): a value of ``WIDE_OWNERS`` owners, or of ``WIDE_REPOSITORIES``
repositories whoever owns them, is a widely copied example (documentation,
templates); of the others a value that looks random is a credential that may be
``live`` where one owner has it and ``shared`` where two have; one that doesn't
look random is ``plain``.

Base kinds (spans of the whole match, code points, end exclusive):
``assign`` (password = ...), ``access`` (AKIA...), ``hex`` (24 and more
digits). Besides these, long mixed tokens that no base span covers are
candidates (``token``). The method adds the spans of the values that are
``live``, ``shared`` or ``copied``, and returns the largest counts of each text.

Only candidates are shuffled, never texts. Counting goes through distinct
(hash, repository, owner) rows, pre-aggregated before each shuffle, so a value
that stands in a third of all documents adds one row per task to its group.

Defined cases: null and empty texts have no span; a null owner or repository
is one more owner or repository; repeated rows are scanned each, and count
once as a repository; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# --- fixed values ---------------------------------------------------------------
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
KINDS = ("assign", "access", "hex", "live", "copied", "shared")
MIN_VALUE, MIN_ACCESS = 6, 20
WIDE_OWNERS = 3         # held by so many owners: a copied example
WIDE_REPOSITORIES = 10  # held by so many repositories, even of one owner: likewise
MIN_ENTROPY = 2.5       # bits a character of a random-looking value
MIN_LIVE = 12           # characters of a random-looking value
PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|dummy|your|xxxx|1234567", re.IGNORECASE)
# --- end of fixed values ----------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of the base kinds, by start,
    then kind."""
    out = [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text)
           if m.end(2) - m.start(2) >= MIN_VALUE]
    out += [(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text)
            if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def token_spans(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Long tokens with letters and digits that touch no covered span; one
    pass over both, by position."""
    out, at, reach = [], 0, 0
    covered = sorted(covered)
    for m in TOKEN.finditer(text):
        # covered spans that start before the token's end: the farthest end decides
        while at < len(covered) and covered[at][0] < m.end():
            reach = max(reach, covered[at][1])
            at += 1
        v = m[0]
        if reach <= m.start() and any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            out.append((m.start(), m.end()))
    return out


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return len(value) >= MIN_LIVE and entropy(value) >= MIN_ENTROPY and not PLACEHOLDER.search(value)


_SCANNED = ("doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base string, "
            "values array<struct<start:int,end:int,hash:string,random:boolean>>")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, owner, repo, text in zip(batch["doc_id"], batch["owner"], batch["repository"], batch["text"],
                                          strict=True):
            spans = base_spans(text)
            inner = list(dict.fromkeys((a, b) for *_, a, b in spans))
            inner += token_spans(text, [(a, b) for a, b, *_ in spans])
            n = Counter(s[2] for s in spans)
            out.append((None if pd.isna(doc) else int(doc), owner, repo, n["assign"], n["access"], n["hex"],
                        ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in spans),
                        [{"start": a, "end": b, "hash": hashlib.sha256(text[a:b].encode()).hexdigest(),
                          "random": looks_random(text[a:b])} for a, b in sorted(inner)]))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCANNED.split(", ")]).astype({"doc_id": "Int64"})


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Candidates of every document; no text leaves its task."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"),
                       F.col(repository).cast("string").alias("repository"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_scan, _SCANNED)


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, repositories, owners): how many distinct ones hold each value."""
    held = scanned.select("owner", "repository", F.explode("values.hash").alias("hash"))
    by_owner = held.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")) \
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def kind_of(owners: Column, repositories: Column, random: Column, wide: int = WIDE_OWNERS,
            wide_repositories: int = WIDE_REPOSITORIES) -> Column:
    """copied, live, shared or plain."""
    return (F.when((owners >= wide) | (repositories >= wide_repositories), "copied")
            .when(random & (owners == 1), "live").when(random, "shared").otherwise("plain"))


def classified(scanned: DataFrame, wide: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """``scanned`` rows (with their ``row``) and ``added``: their values with kind and counts."""
    found = scanned.select("row", F.inline("values"))
    frequency = checkpointed(ownership(scanned))
    kind = kind_of(F.col("owners"), F.col("repositories"), F.col("random"), wide, wide_repositories)
    added = (found.join(frequency, "hash").withColumn("kind", kind).groupBy("row").agg(F.collect_list(
        F.struct("start", "end", "kind", "owners", "repositories")).alias("added")))  # the values of one document
    return scanned.join(added, "row", "left")


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def scan_documents(docs: DataFrame, wide: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    n_shared, n_plain, and the most owners and repositories of a value (0: no
    value) of every row."""
    scanned = checkpointed(scan(docs).withColumn("row", F.monotonically_increasing_id()))
    rows = classified(scanned, wide, wide_repositories)
    parts = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    base = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(1)).cast("int").alias("start"),
                                                 rank_of(F.get(p, F.lit(0))).cast("int").alias("rank"),
                                                 F.get(p, F.lit(2)).cast("int").alias("end"),
                                                 F.get(p, F.lit(0)).alias("kind")))
    added = F.transform(F.filter("added", lambda s: s["kind"] != "plain"), lambda s: F.struct(s["start"].alias("start"), rank_of(s["kind"]).cast("int").alias("rank"),
                                                    s["end"].alias("end"), s["kind"].alias("kind")))
    everything = F.array_sort(F.concat(base, F.coalesce(added, F.array().cast(
        "array<struct<start:int,rank:int,end:int,kind:string>>"))))
    spans = F.array_join(F.transform(everything, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("added", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
                       spans.alias("spans"), *[number(k).alias(f"n_{k}") for k in ("live", "copied", "shared", "plain")],
                       *[F.coalesce(F.array_max(f"added.{c}"), F.lit(0)).cast("long").alias(f"most_{c}")
                         for c in ("owners", "repositories")])
