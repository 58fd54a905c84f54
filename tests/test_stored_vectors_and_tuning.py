"""The per-row encoder, stored vectors, dense stages and grid search."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from rankframe.functions.text import RAW
from rankframe.operators import dense as dn
from rankframe.operators import evaluate as ev
from rankframe.operators.index import build_index
from rankframe.operators.vectors import VectorStore
from rankframe.plans.algebra import DenseScore, Interpolate, Retriever, stage
from rankframe.plans.tuning import grid_search

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty".split()


def plain_vector(text: str, dim: int = dn.DIM) -> list[float] | None:
    """The hashed vector by counting, without any array function."""
    v = [0.0] * dim
    for t in text.split():
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:4], 16) % dim] += 1.0 if int(h[4], 16) % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else None


def test_hashed_vectors_equal_a_plain_count_without_a_shuffle(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=n)) for n in (1, 2, 7, 40)] + ["", "...", " ".join(rng.choices(WORDS, k=30_000))]
    texts.append(" ".join(f"w{i}" for i in range(20_000)))
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, text string")
    out = dn.encode(rows, "i", "text", RAW)
    found = {r["id"]: r["vector"] for r in out.collect()}
    for i, text in enumerate(texts):
        want = plain_vector(text.replace(".", ""))
        assert (i in found) == (want is not None)
        if want:
            assert found[i] == pytest.approx(want, abs=1e-12)
    assert 99 not in found
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def dense_case(spark):
    """200 documents with a vector (some with two), 3 without, 2 queries."""
    rng = random.Random(11)
    vector = lambda: [round(rng.gauss(0, 1), 3) for _ in range(16)]
    rows = [(f"d{i}", vector()) for i in range(200)] + [(f"d{i}", vector()) for i in range(0, 200, 7)]
    rows += [("zero", [0.0] * 16), ("copy1", rows[3][1]), ("copy2", rows[3][1])]
    vectors = spark.createDataFrame(rows, "docno string, vector array<double>")
    queries = spark.createDataFrame([("q1", vector()), ("q2", rows[3][1])], "id string, vector array<double>")
    names = sorted({d for d, _ in rows} | {"gone1", "gone2", "gone3"})
    run = spark.createDataFrame([(q, d, float(i)) for q in ("q1", "q2") for i, d in enumerate(names)],
                                "qid string, docno string, score double")
    return vectors, queries, run


def rows_of(df):
    return sorted(tuple(r[c] for c in ("qid", "docno", "score_0", "score", "rank")) for r in df.collect())


def test_stored_vectors_score_like_the_table(spark, dense_case, tmp_path):
    vectors, queries, run = dense_case
    path = str(tmp_path / "vectors")
    VectorStore.write(vectors, path, "test", buckets=8)
    store = VectorStore.load(spark, path, "test")
    whole = dn.dense_score(run, queries, vectors)
    assert rows_of(store.scores(run, queries)) == rows_of(whole)
    for k in (1, 2, 10, 150, 1000):
        assert rows_of(store.best(run, queries, k)) == rows_of(whole.filter(F.col("rank") < k))
    # codes leave few candidates, and are read without the whole vectors
    few = store.candidates(run, queries, 5)
    assert few.count() < 40
    scans = [x for x in few._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert scans and all("codes" in x and "vector" not in x.split("ReadSchema")[1] for x in scans)
    assert store.best(run.limit(0), queries, 5).count() == 0
    one = run.filter("docno = 'd5'")
    scanned = store.read(one).inputFiles(), store.table.inputFiles()
    assert len(store.read(one).select("docno").distinct().collect()) < 203 and scanned[1]
    assert "bucket" in store.read(one)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_a_build_counts_once_it_is_committed(spark, dense_case, tmp_path):
    vectors, queries, run = dense_case
    path = str(tmp_path / "vectors")
    with pytest.raises(FileNotFoundError):
        VectorStore.load(spark, path)
    # a writer that died: tables without a commit, and a commit without its end mark
    vectors.write.parquet(f"{path}/builds/dead")
    vectors.limit(1).write.parquet(f"{path}/commits/000000000000-dead")
    (tmp_path / "vectors/commits/000000000000-dead/_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        VectorStore.load(spark, path)
    calls = []

    def encode(rows):
        return lambda: calls.append(1) or rows
    first = VectorStore.open_or_encode(spark, path, encode(vectors), "test")
    again = VectorStore.open_or_encode(spark, path, encode(vectors.limit(1)), "test")
    assert len(calls) == 1 and again.table.count() == first.table.count() == vectors.count()
    forced = VectorStore.open_or_encode(spark, path, encode(vectors.limit(1)), "test", force=True)
    assert len(calls) == 2 and forced.table.count() == 1
    with pytest.raises(ValueError, match="encoder|not"):
        VectorStore.load(spark, path, "another")
    with pytest.raises(FileExistsError):
        VectorStore.write(vectors, path, "test")


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(3)
    docs = [(f"d{i}", " ".join(rng.choices(WORDS, k=12))) for i in range(60)]
    corpus = spark.createDataFrame(docs, "docno string, text string")
    index = build_index(corpus, RAW)
    topics = spark.createDataFrame([("1", "amber cedar"), ("2", "fjord haven"), ("3", "jetty")], "qid string, query string")
    qrels = spark.createDataFrame([("1", "d3", 1), ("1", "d9", 1), ("2", "d4", 1), ("3", "d7", 1), ("8", "d1", 1)],
                                  "qid string, docno string, label int")
    vectors = dn.encode(corpus, "docno", "text", RAW).withColumnRenamed("id", "docno")
    encode = lambda t: dn.encode(t, "qid", "query", RAW)
    yield index, topics, qrels, vectors, encode
    index.unpersist()


def test_dense_stages_keep_queries_and_read_a_store(spark, searched, tmp_path):
    index, topics, _, vectors, encode = searched
    path = str(tmp_path / "stage-vectors")
    VectorStore.write(vectors, path, "hashed")
    tree = Retriever(index, "BM25", 30) >> DenseScore(vectors, encode, "hashed") >> Interpolate(0.4)
    stored = Retriever(index, "BM25", 30) >> DenseScore(VectorStore.load(spark, path), encode, "hashed") >> Interpolate(0.4)
    out = tree(topics)
    assert {"query", "qid", "docno", "score"} <= set(out.columns)
    assert rows_of(out) == rows_of(stored(topics))
    head = Retriever(index, "BM25", 30) >> DenseScore(vectors, encode, "hashed")
    cut = Retriever(index, "BM25", 30) >> DenseScore(VectorStore.load(spark, path), encode, "hashed")
    assert rows_of((cut % 4)(topics)) == rows_of(head(topics).filter("rank < 4"))
    # equal stores are equal stages, plain tables only themselves; another encoder or build is another stage
    again = DenseScore(VectorStore.load(spark, path), encode, "hashed")
    assert again.key == cut.parts[1].key != DenseScore(VectorStore.load(spark, path), encode, "other").key
    assert DenseScore(vectors, encode, "hashed").key != head.parts[1].key
    # a retriever can follow
    assert (head >> Retriever(index, "TF_IDF", 5))(topics).count() == 15


def test_grid_search_equals_every_setting_alone(spark, searched):
    index, topics, qrels, vectors, encode = searched
    tree = Retriever(index, "BM25", 30) >> DenseScore(vectors, encode, "hashed") >> Interpolate()
    grid = {"BM25__k": [3, 30], "interpolate__alpha": [0, 0.5, 1]}
    found = grid_search(tree, grid, topics, qrels)
    rows = {(r["BM25__k"], r["interpolate__alpha"]): r for r in found.table.collect()}
    assert len(rows) == 6 and sum(r["best"] for r in rows.values()) == 1
    for (k, alpha), r in rows.items():
        alone = tree.with_parameters({"BM25__k": k, "interpolate__alpha": alpha})
        judged = qrels.filter("qid <> '8'")
        want = ev.evaluate_run(alone(topics), judged, ["map"], missing="zero").first()["value"]
        assert r["value"] == pytest.approx(want, abs=1e-12)
    assert found.value == max(r["value"] for r in rows.values())
    assert found.stage.parameters() == {"BM25__k": found.setting["BM25__k"],
                                        "interpolate__alpha": found.setting["interpolate__alpha"]}
    assert tree.parameters()["interpolate__alpha"] == 0.5  # the tree itself is left as it was


def test_grid_search_without_a_sweep_and_without_judgments(spark, searched):
    index, topics, qrels, _, _ = searched
    found = grid_search(Retriever(index, "BM25", 30), {"BM25__k": [1, 30]}, topics, qrels, "recall_100")
    assert found.setting == {"BM25__k": 30}
    none = grid_search(Retriever(index, "BM25", 30), {"BM25__k": [2, 1]}, topics, qrels.limit(0))
    assert none.setting == {"BM25__k": 2} and none.value is None
    with pytest.raises(ValueError):
        grid_search(Retriever(index, "BM25", 30), {"BM25__alpha": [1]}, topics, qrels)
    with pytest.raises(KeyError):
        stage(lambda df: df).with_parameters({"x": 1})
