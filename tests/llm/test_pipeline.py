"""The pipeline on planted documents: toxic ones, copies and leaks go, clean ones stay."""
import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Rows by what should become of them."""
    rng = random.Random(21)
    clean = {i: words(rng, rng.randint(60, 200)) for i in range(80)}
    insults = ["idiot", "moron", "scum", "pathetic", "stupid", "worthless", "disgusting"]
    toxic = {100 + i: " ".join(w for p in words(rng, 80).split() for w in ([p, rng.choice(insults)] if rng.random() < 0.08 else [p])) + " idiot moron"
             for i in range(40)}
    copies = {200 + i: clean[i] for i in range(10)}
    near = {220 + i: clean[20 + i] + " tail" for i in range(10)}
    items = {i: f"{words(rng, 30)}. {words(rng, 12)}." for i in range(6)}
    leaks = {300 + i: f"{words(rng, 80)} {items[i]} {words(rng, 90)}" for i in range(6)}
    return clean, toxic, copies, near, items, leaks


def save(spark, folder, rows, items, labels, extra=()):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        out[name] = docs
    return out


def test_planted_documents(spark, planted, tmp_path):
    clean, toxic, copies, near, items, leaks = planted
    texts = clean | toxic | copies | near | leaks
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    rows += [(None, "one row without an id of quite some words here", "en", None, 9), (None, "another row without an id, of other words", None, "s0", 9),
             (900, None, "en", "s1", None), (901, "", "en", "s1", 0), rows[50]]
    labels = [(i, 1, 0) for i in clean] + [(i, 1, 1) for i in toxic]
    out = stages(spark, save(spark, tmp_path, rows, list(items.items()), labels))
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in out.items()}
    base = set(SCHEMA.split()[::2])
    assert all(base <= set(df.columns) for df in out.values())

    kept = set(ids["toxicity"])
    assert not kept & set(toxic) and set(clean) | set(copies) | set(near) | set(leaks) <= kept
    assert ids["toxicity"].count(None) == 2 and {900, 901} <= kept

    once = ids["simhash_near_dedup"]
    assert len({900, 901} & set(once)) == 1 and once.count(None) == 2 and once.count(50) == 1
    for i in copies:
        assert len({i, i - 200} & set(once)) == 1
    for i in near:   # one word more in a long text: within the radius, or both stay
        assert {i, i - 200} & set(once)
    assert sum(len({i, i - 200} & set(once)) == 1 for i in near) >= 5
    assert set(clean) - set(range(10)) - set(range(20, 30)) <= set(once)

    unseen = ids["decontamination"]
    assert not set(unseen) & set(leaks) and sorted(map(str, unseen)) == sorted(str(i) for i in once if i not in leaks)
    assert set(ids["mixing"]) <= set(unseen)

    last = out["sharding"].collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(map(str, ids["mixing"]))
    for shard in {r.shard for r in last}:
        assert sorted(r.slot for r in last if r.shard == shard) == list(range(sum(r.shard == shard for r in last)))


def test_odd_tables(spark, planted, tmp_path):
    clean, toxic, *_ = planted
    labels = [(0, 1, 0), (0, 1, 1), (None, 1, 1), (100, None, None)]
    empty = save(spark, tmp_path / "empty", [], [], [])
    assert pipeline.run(spark, empty).count() == 0
    rows = [(i, t, "en", "s", len(t)) for i, t in list(clean.items())[:5]] + [(7000, "word " * 60_000, "en", "s", 1)]
    clashing = save(spark, tmp_path / "clash", rows, [(None, "an item without an id " * 5), (1, None), (2, "")], labels,
                    ("score", "predicted", "shard", "slot", "fp", "component_id", "size", "copy", "_row"))
    out = pipeline.run(spark, clashing)
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r[0] for r in rows} and out.count() > 0
