"""Fixtures and helpers of these tests (imported by name)."""

import random

import pytest

SMOKE = "/root/testdata/sf0.001"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")




# extra columns whose names operators use inside
CLASH = ["_key", "_row", "node", "set", "block", "size", "kept", "score", "host", "n", "a"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names."""
    long_text = "\n".join(prose(i, 40) for i in range(400))
    base = prose(7, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base, "a"), (1, base, "a"), (2, " ".join(near), "a"), (3, None, "b"), (4, "", "b"), (5, " \n\t ", None),
            (6, long_text, "b"), (None, prose(8, 120), "b"), (None, prose(8, 120), "b"), (None, None, None),
            (7, "x" * 700, "c"), (8, "same words " * 150, "c"), (9, prose(9, 3), "c"), (10, "é# " * 60 + prose(10, 80), "b")]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * len(CLASH)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
