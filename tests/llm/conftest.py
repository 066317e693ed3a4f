import random

import pytest

VOWELS, STOPS = "aeiou", "bdfgklmnprst"


def prose(seed, n):
    """n invented words in sentences."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(STOPS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, with columns whose names the operators use too."""

    def make(texts, ids=None, sources=None):
        rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t), i, 0.5, "k") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string")

    return make


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty, blank, short, repeated, tied, non-ASCII and long ones."""
    long = " ".join(prose(k, 2000) for k in range(4))
    return [None, "", " \t\n", "one", "a b c d", prose(1, 60), prose(1, 60), "é ü 日本語 🙂 " * 10, long, long, "a " * 3000, "x" * 30000, "1" * 5000, "+1 " * 500, "a@b.c_d@e.f " * 50, None]


@pytest.fixture(scope="session")
def edge(docs_of, edge_texts):
    n = len(edge_texts)
    return docs_of(edge_texts, [None if i in (3, 15) else i if i != 6 else 5 for i in range(n)], [None if i % 5 == 0 else f"s{i % 2}" for i in range(n)])


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
