"""Small tables with the awkward rows that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, lang="en", source="s", extra=False):
        """Documents from texts, or from (doc_id, text) pairs; ``extra`` adds columns with clashing names."""
        rows = []
        for k, t in enumerate(texts):
            doc_id, text = t if isinstance(t, tuple) else (k, t)
            rows.append((doc_id, text, lang, source, len(text or "")))
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            for name in ("key", "rid", "fp", "size", "kind", "k", "h", "score", "pattern", "copies", "target", "ids", "path_"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return build


@pytest.fixture(scope="session")
def words():
    """Seeded prose: n words from a small vocabulary that depends on the seed."""
    import random

    def build(n, seed=0, vocabulary=400):
        r = random.Random(seed)
        names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(vocabulary)]
        return " ".join(r.choice(names) for _ in range(n))

    return build
