import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts or (id, text[, source]) tuples, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        out = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            out.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")))
        df = spark.createDataFrame(out, DOCS)
        if extra:
            for name in ("doc", "ver", "fp", "score", "size", "start", "n", "id", "copies", "words", "held_out"):
                df = df.selectExpr("*", f"'extra' AS {name}")
        return df

    return make


@pytest.fixture
def words():
    """Seeded texts of ``n`` words from a small vocabulary."""

    def words(seed, n, vocabulary=400):
        r = random.Random(seed)
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]

    return words
