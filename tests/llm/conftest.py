import random

import pytest

_A, _B = "ba de fi go hu ka le mi no pu ra se ti vo xu".split(), "ban del fin gor hum kas lem min nor pus".split()
WORDS = [f"{a}{b}" for a in _A for b in _B] + [f"{b}{a}{b[1:]}" for a in _A[:8] for b in _B] + [a + c for a in _A for c in "nrs"]


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, an empty and a very long text, ties, repeated rows, clashing column names."""
    def make(extra=()):
        rows = [(1, None, "en", "s"), (2, "", None, None), (None, "one text", "en", "s"), (3, " \n\t ", "en", "s"),
                (4, "same text here", "en", "s"), (4, "same text here", "en", "s"), (5, "same text here", None, "t"),
                (6, "long " * 60_000, "en", "s"), *extra]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        # names that operators use for their own results or might use inside
        return df.selectExpr("*", "7L AS n_chars", "'x' AS shard", "'x' AS label", "'x' AS kept", "'x' AS ids", "'x' AS k",
                             "'x' AS bucket", "'x' AS n_tokens", "'x' AS spans", "'x' AS bad", "'x' AS id")

    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
