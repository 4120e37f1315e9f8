import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, mark string, pos string, key string, at string, shard string, root string, n string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text), with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 8) for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows and a very long text."""
    base = " ".join(f"w{k}" for k in range(120))
    return [
        (5, base), (5, base), (3, base.replace(" ", "\t\n")), (9, base + " tail"), (7, None), (8, ""), (2, " \n\t "), (11, "short text"), (12, "Short TEXT"),
        (None, base), (None, None), (20, "x " * 60_000 + base), (21, "y" * 50_000), (22, "new start " + " ".join(f"w{k}" for k in range(10, 100)) + " new end"),
    ]
