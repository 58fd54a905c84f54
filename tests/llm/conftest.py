import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was here, and then it went away again.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "   \t\n ", "b"),
    (5, "one", "b"),
    (6, "Größe der Straße für naïve Café-Gäste 日本語 text 🙂 " * 3, "b"),
    (6, "Größe der Straße für naïve Café-Gäste 日本語 text 🙂 " * 3, "b"),   # a repeated row
    (7, "word " * 30_000, "c"),                                             # very long
    (8, " ".join(f"w{i % 977}x{i}" for i in range(20_000)), "c"),
    (9, "The quick brown fox jumps over the lazy dog. It was here, and then it went away again.", "c"),
    (None, "a row without an id that has a few words of its own", "c"),
    (10, "you idiot moron scum", "a"),
]
SCHEMA = "doc_id long, text string, source string, size string, score string, shard string, _row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeats, extra columns that clash."""
    return spark.createDataFrame([(d, t, s, "x", "y", "z", "r") for d, t, s in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (5, 1, 0), (6, 0, 0), (7, 0, None), (9, None, 0), (10, 1, 1), (10, 1, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
