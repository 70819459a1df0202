import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text, and columns whose names clash with results)."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s1", None if t is None else len(t), -1, "old") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string")

    return make


@pytest.fixture
def words():
    import random

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return make
