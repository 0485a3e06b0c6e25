import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner string, n long"


def rows_of(texts, sources=("a", "b", None)):
    """Rows with the columns of documents and two whose names clash with those that operators use inside."""
    return [(i, t, "en", sources[(i or 0) % len(sources)], len(t or ""), "x", 7) for i, t in texts]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, **more: spark.createDataFrame(rows_of(texts, **more), SCHEMA)


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(4)
    words = ["".join(rng.choice("ba co du fe gi ho ju ka le mi no pu".split()) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choice(words) for _ in range(n))
