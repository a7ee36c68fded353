import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents of (id, text), with columns whose names the operators use themselves."""

    def make(rows, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t), 1, 2.0, "x") for i, t in rows]
        return spark.createDataFrame(rows, f"{DOC}, key int, score double, runs string")

    return make


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


ODD = [(None, "a text without an id"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (5, "one"), (6, "É 🙂 ﬁ ▁ x"), (7, "a" * 5000), (8, "x y\n" * 3000)]
