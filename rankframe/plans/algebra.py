"""Ranking algebra: composable stages over DataFrames.

A ``Stage`` wraps a function DataFrame → DataFrame (topics → run, run → run,
run → topics). Operators build a tree, and calling the tree builds one lazy
Catalyst plan:

  a >> b   compose (b consumes a's output)
  a % k    keep the k best per query (row_number ≤ k → WindowGroupLimit)
  a + b    score sum over the union of documents, a missing document counts
           0 — n-ary: unionByName + groupBy(qid, docno).sum (no full outer
           join chain)
  w * a    scale scores
  a ** b   feature union: features appended left to right (flattened, so
           Python's right-associative ** keeps the order)
  cached   parquet cache under the shared checkpoint folder keyed by the
           stage and (qid, query): misses are computed (anti join) and appended

Every stage keeps ``query`` and the further columns of its input, so any stage
can follow any other. Within one call equal sub-stages on the same input are
built once, and retrievers of one index that score the same run (as in
``a ** (a >> b) ** (a >> c)``) share one pass over the postings. A cutoff
moves into the retriever below it, through ``>>`` and through scaling by a
positive weight.

``parameters()`` names what can be tuned in a tree, as ``stage__parameter``;
``with_parameters`` gives a tree with other values (see ``plans.tuning``).
"""

from __future__ import annotations

import copy
import hashlib
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, rewrite
from ..operators.index import Index
from ..operators.retrieve import best_matches, query_terms, rank_within, rescore_models, retrieve
from ..operators.vectors import VectorStore
from ..session import ensure_checkpoint_dir
from ..sinks import child_folders, path_exists

_RESULT = ("score", "rank", "score_0", "features")


def carried(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """What a stage hands through (query and further columns) and its key."""
    df = df.withColumn("qid", F.col("qid").cast("string")).drop(*_RESULT)
    return df, ["qid", "docno"] if "docno" in df.columns else ["qid"]


class Stage:
    tunable: tuple[str, ...] = ()   # attributes that can be set by name

    def __init__(self, fn=None, name: str = "stage", key: str | None = None):
        """``key`` names everything that changes the result. Without one a
        stage equals only itself: its cache is never taken for another's."""
        self.fn, self.name = fn, name
        self._key = key or f"{name}#{uuid.uuid4().hex}"

    @property
    def key(self) -> str:
        """Identity of the result across sessions; an index takes part with its contents."""
        return self._key

    @property
    def local(self) -> str:
        """Identity inside this process, without any job."""
        return self._key

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.build(df, {})

    transform = __call__

    def build(self, df: DataFrame, built: dict) -> DataFrame:
        """The stage's result for ``df``; built once per call and input."""
        at = (id(df), self.local)
        if at not in built:
            built[at] = (df, self._apply(df, built))  # keeps df, so that its id stays taken
        return built[at][1]

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        return self.fn(df)

    def cut(self, k: int) -> "Stage":
        return Cut(self, k)

    def __rshift__(self, other: "Stage") -> "Stage":
        return Then([*(self.parts if isinstance(self, Then) else [self]),
                     *(other.parts if isinstance(other, Then) else [other])])

    def __mod__(self, k: int) -> "Stage":
        return self.cut(k)

    def __mul__(self, w: float) -> "Stage":
        return Scaled(self, float(w))

    __rmul__ = __mul__

    def __add__(self, other: "Stage") -> "Stage":
        return SumStage([*(self.parts if isinstance(self, SumStage) else [self]),
                         *(other.parts if isinstance(other, SumStage) else [other])])

    def __pow__(self, other: "Stage") -> "Stage":
        return UnionStage([*(self.parts if isinstance(self, UnionStage) else [self]),
                           *(other.parts if isinstance(other, UnionStage) else [other])])

    def fingerprint(self) -> str:
        return hashlib.md5(self.key.encode()).hexdigest()

    def parameters(self) -> dict:
        return {f"{self.name}__{p}": getattr(self, p) for p in self.tunable}

    def with_parameters(self, values: dict) -> "Stage":
        """This stage with other values; names it doesn't know are an error."""
        unknown = set(values) - set(self.parameters())
        if unknown:
            raise KeyError(f"no parameter {sorted(unknown)} in {self.name}")
        out = copy.copy(self)
        for name, value in values.items():
            setattr(out, name.rsplit("__", 1)[1], value)
        return out


class _Node(Stage):
    """A stage made of others; ``mark`` and the parts tell it apart."""

    def __init__(self, parts: list[Stage], mark: str):
        self.parts, self.mark = parts, mark
        self.name = self._joined(p.name for p in parts)

    def _joined(self, names) -> str:
        return "(" + f" {self.mark} ".join(names) + ")"

    def parameters(self) -> dict:
        return {name: value for p in self.parts for name, value in p.parameters().items()}

    def with_parameters(self, values: dict) -> Stage:
        unknown = set(values) - set(self.parameters())
        if unknown:
            raise KeyError(f"no parameter {sorted(unknown)} in {self.name}")
        out = copy.copy(self)
        out.parts = [p.with_parameters({n: v for n, v in values.items() if n in p.parameters()}) for p in self.parts]
        return out

    @property
    def key(self) -> str:
        return self._joined(p.key for p in self.parts)

    @property
    def local(self) -> str:
        return self._joined(p.local for p in self.parts)


class Then(_Node):
    def __init__(self, parts: list[Stage]):
        super().__init__(parts, ">>")

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        return reduce(lambda x, p: p.build(x, built), self.parts, df)

    def cut(self, k: int) -> Stage:
        return Then([*self.parts[:-1], self.parts[-1] % k])


class Cut(_Node):
    def __init__(self, inner: Stage, k: int):
        self.k = k
        super().__init__([inner], f"% {k}")

    def _joined(self, names) -> str:
        return f"({next(iter(names))} {self.mark})"

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        return rank_within(self.parts[0].build(df, built).drop("rank"), self.k)

    def cut(self, k: int) -> Stage:
        return Cut(self.parts[0], min(k, self.k))


class Scaled(_Node):
    def __init__(self, inner: Stage, w: float):
        self.w = w
        super().__init__([inner], repr(w))

    def _joined(self, names) -> str:
        return f"({self.mark} * {next(iter(names))})"

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        out = self.parts[0].build(df, built).withColumn("score", F.col("score") * F.lit(self.w))
        # a negative weight turns the order round
        return rank_within(out.drop("rank")) if "rank" in out.columns else out

    def cut(self, k: int) -> Stage:
        return Scaled(self.parts[0] % k, self.w) if self.w > 0 else Cut(self, k)


class Retriever(Stage):
    """Retrieval with one weighting model as a stage. Topics (qid, query, ...)
    give the k best documents; a run with its ``query`` is scored anew, its own
    documents only (old score in ``score_0``). Topics with ``query_terms``
    (after a feedback stage) are searched by those weighted terms, topics with
    ``dependence`` by single terms and pairs. A cutoff lowers k itself."""

    tunable = ("k",)

    def __init__(self, index: Index, model: str = "BM25", k: int = 1000, source: str = ""):
        self.index, self.model, self.k, self.source = index, model, k, source
        self.name = model

    @property
    def key(self) -> str:
        return f"{self.model}@{self.k}|{self.index.analyzer}|{self.index.identity}"

    @property
    def local(self) -> str:
        return f"{self.model}@{self.k}|{id(self.index)}"

    def cut(self, k: int) -> Stage:
        return Retriever(self.index, self.model, min(k, self.k), self.source)

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        kept, on = carried(df)
        if "docno" in df.columns:
            scored = rescore_models(self.index, df, [self.model]).withColumnRenamed(self.model, "score")
            return rank_within(scored, self.k).join(kept, on)
        if "query_terms" in df.columns:
            terms = kept.select("qid", F.inline("query_terms"))
            return retrieve(self.index, model=self.model, k=self.k, qterms=terms).join(kept.drop("query_terms"), on)
        if "dependence" in df.columns:
            postings, lexicon, q = rewrite.sdm_query(self.index, kept)
            s = best_matches(self.index, q, (self.model,), self.k, postings, lexicon)
            s = s.select("qid", "docno", F.round(F.col(self.model), 6).alias("score"))
            return rank_within(s, self.k).persist().join(kept.drop("dependence"), on)
        return retrieve(self.index, df, self.model, self.k).join(kept, on)


class Feedback(Stage):
    """A run with its queries → topics with ``query_terms``, the weighted terms
    of the query and of its best documents (``Bo1`` or ``RM3``)."""

    def __init__(self, index: Index, kind: str = "RM3", **options):
        self.index, self.kind, self.options = index, kind, options
        self.name = kind

    @property
    def key(self) -> str:
        return f"{self.kind}{sorted(self.options.items())}|{self.index.identity}"

    @property
    def local(self) -> str:
        return f"{self.kind}{sorted(self.options.items())}|{id(self.index)}"

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        topics = df.drop("docno", *_RESULT).dropDuplicates(["qid"])
        expand = {"Bo1": rewrite.bo1_terms, "RM3": rewrite.rm3_terms}[self.kind]
        terms = expand(self.index, df, query_terms(topics, self.index.analyzer), **self.options)
        per_query = terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "qtf"))).alias("query_terms"))
        return topics.join(per_query, "qid")


class SequentialDependence(Stage):
    """Topics whose next retriever scores single terms, ordered and unordered pairs."""

    def __init__(self):
        super().__init__(None, "SDM", "SDM")

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        return df.withColumn("dependence", F.lit(True))


class DenseScore(Stage):
    """A run with its queries → the same candidates scored by vectors, the old
    score in ``score_0``. ``vectors``: (docno, vector) or a ``VectorStore``;
    ``encode``: topics (qid, query) → (id, vector); ``encoder`` names it. A
    cutoff over a store reads the codes of all candidates and whole vectors of
    the best alone."""

    def __init__(self, vectors, encode, encoder: str = "", k: int | None = None):
        self.vectors, self.encode, self.k = vectors, encode, k
        self.encoder = encoder or f"encoder#{uuid.uuid4().hex}"
        # a plain table can't be told by name: its stage equals only itself
        self.source = vectors.build if isinstance(vectors, VectorStore) else uuid.uuid4().hex
        self.name = "dense"

    @property
    def key(self) -> str:
        return f"dense@{self.k}|{self.encoder}|{self.source}"

    @property
    def local(self) -> str:
        return self.key

    def cut(self, k: int) -> Stage:
        out = copy.copy(self)
        out.k = min(k, self.k or k)
        return out

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        kept, on = carried(df)
        queries = self.encode(df.select("qid", "query").distinct())
        if not isinstance(self.vectors, VectorStore):
            scored = dense.dense_score(df, queries, self.vectors)
            scored = rank_within(scored.drop("rank"), self.k) if self.k else scored
        elif self.k:
            scored = self.vectors.best(df.select("qid", "docno", "score"), queries, self.k)
        else:
            scored = self.vectors.scores(df, queries)
        return scored.join(kept, on)


class Interpolate(Stage):
    """alpha * score_0 + (1 - alpha) * score."""

    tunable = ("alpha",)

    def __init__(self, alpha: float = 0.5):
        self.alpha, self.name = float(alpha), "interpolate"

    @property
    def key(self) -> str:
        return f"interpolate@{self.alpha}"

    local = key

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        return dense.interpolate(df, self.alpha)

    def sweep(self, df: DataFrame, setting) -> DataFrame:
        """Scores for every setting in one plan: ``setting`` is an array of
        structs with this stage's parameters, one of which each row gets."""
        rows = df.select("qid", "docno", "score_0", "score", F.explode(setting).alias("setting"))
        return rows.select("qid", "docno", "setting", dense.mixed(F.col(f"setting.{self.name}__alpha")).alias("score"))


class SumStage(_Node):
    def __init__(self, parts: list[Stage]):
        super().__init__(parts, "+")

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        runs = [p.build(df, built).select("qid", "docno", F.col("score").cast("double").alias("score"))
                for p in self.parts]
        s = reduce(DataFrame.unionByName, runs).groupBy("qid", "docno").agg(F.round(F.sum("score"), 6).alias("score"))
        if df is None:  # stages that bring their own rows: nothing to hand through
            return rank_within(s)
        kept, on = carried(df)
        return rank_within(s).join(kept, on)


class UnionStage(_Node):
    """First stage gives the candidates and score; every stage contributes
    its score as the next feature (a stage output may already carry a
    ``features`` array, which is spliced in). Parts that begin with the first
    stage go on from its result; retrievers among them, of one index, are
    scored together."""

    def __init__(self, parts: list[Stage]):
        super().__init__(parts, "**")

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        base = self.parts[0].build(df, built)
        out = base.withColumn("_f0", _features(base)).drop("features")
        together: dict[int, list[tuple[int, Retriever]]] = {}
        for i, part in enumerate(self.parts[1:], start=1):
            rest = _after(self.parts[0], part)
            if len(rest) == 1 and isinstance(rest[0], Retriever) and "query" in base.columns:
                together.setdefault(id(rest[0].index), []).append((i, rest[0]))
                continue
            run = Then(rest).build(base, built) if rest else part.build(df, built)
            out = out.join(run.select("qid", "docno", _features(run).alias(f"_f{i}")), ["qid", "docno"], "left")
        for group in together.values():
            models = list(dict.fromkeys(r.model for _, r in group))
            scored = rescore_models(group[0][1].index, base, models)
            # a retriever's own cutoff keeps k of the candidates; the others count 0
            for i, r in group:
                ranked = rank_within(scored, None, r.model)
                scored = ranked.withColumn(f"_f{i}", F.when(F.col("rank") < r.k, F.array(F.col(r.model)))).drop("rank")
            out = out.join(scored.select("qid", "docno", *[f"_f{i}" for i, _ in group]), ["qid", "docno"], "left")
        parts = [F.coalesce(F.col(f"_f{i}"), F.array(F.lit(0.0))) for i in range(len(self.parts))]
        return out.withColumn("features", F.concat(*parts)).drop(*[f"_f{i}" for i in range(len(self.parts))])


def _features(run: DataFrame):
    return F.col("features") if "features" in run.columns else F.array(F.col("score"))


def _after(first: Stage, part: Stage) -> list[Stage]:
    """The stages of ``part`` behind ``first``, if it begins with that."""
    head = first.parts if isinstance(first, Then) else [first]
    if isinstance(part, Then) and [p.local for p in part.parts[:len(head)]] == [p.local for p in head]:
        return part.parts[len(head):]
    return []


def stage(fn, name: str | None = None, key: str | None = None) -> Stage:
    return Stage(fn, name or getattr(fn, "__name__", "stage"), key)


class Cached(_Node):
    """Memo of a topics → run stage. Each call that meets new queries writes
    one folder (the queries, then their rows); a folder counts once Spark's
    committer has marked both as complete, so a crashed writer leaves nothing
    visible. Of two writers that met the same query the first folder by name
    holds."""

    def __init__(self, inner: Stage, path: str | None = None):
        self.path = path
        super().__init__([inner], "cached")

    def _joined(self, names) -> str:
        return f"cached{next(iter(names))}"

    def folder(self, spark) -> str:
        base = self.path or os.path.join(ensure_checkpoint_dir(spark), "rankframe-cache")
        return os.path.join(base, self.parts[0].fingerprint())

    def _complete(self, spark) -> list[str]:
        folder = self.folder(spark)
        return [f for f in child_folders(spark, folder)
                if all(path_exists(spark, f"{f}/{part}/_SUCCESS") for part in ("queries", "rows"))]

    def _apply(self, df: DataFrame, built: dict) -> DataFrame:
        spark = df.sparkSession
        kept, _ = carried(df)
        asked = kept.select("qid", "query").distinct()
        done = self._complete(spark)
        missing = asked.join(_queries(spark, done), ["qid", "query"], "left_anti") if done else asked
        if not done or not missing.isEmpty():
            target = f"{self.folder(spark)}/{uuid.uuid4().hex}"
            missing.write.parquet(f"{target}/queries")
            new = spark.read.parquet(f"{target}/queries")
            rows = self.parts[0].build(new, {})
            rows = rows if "query" in rows.columns else rows.join(new, "qid")
            rows.write.parquet(f"{target}/rows")
            done = sorted([*done, target])
        owner = _queries(spark, done).groupBy("qid", "query").agg(F.min("_folder").alias("_folder"))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                      [spark.read.parquet(f"{f}/rows").withColumn("_folder", F.lit(f)) for f in done])
        return (rows.join(owner, ["qid", "query", "_folder"], "left_semi").drop("_folder")
                .join(kept, ["qid", "query"]))


def _queries(spark, folders: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{f}/queries").withColumn("_folder", F.lit(f))
                                          for f in folders])


def cached(st: Stage, path: str | None = None) -> Stage:
    """Memoise a topics → run stage in parquet tables keyed by the stage and
    (qid, query). Only queries not yet cached are computed."""
    return Cached(st, path)
